"""From raw documents to token ids: five stages of corpus operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages it is written as
Parquet and read again, so a lost executor costs one stage's task and no lineage grows. All stages
but the last return the columns of ``documents``:

1. quality      rejects documents beyond their language's perplexity threshold
2. line_dedup   takes widely repeated lines out of all documents but the last that has them
3. near_dedup   keeps one document, of the smallest doc_id, of each group of near copies
4. mix          takes each source's documents as often as its target weight asks, whole
5. byte_bpe     encodes and decodes: (doc_id, n_tokens, ids_sha256, decoded_sha256)

Defined results: an empty table goes through as an empty table; null texts stay, and are empty for
the last stage; repeated rows count each, until stage 3 keeps one of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from meridia.llm import bpe_codec, line_dedup, mixing, quality, shingle_join
from meridia.llm.common import scratch_path, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.drop_lines(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shingle_join.drop_near_copies(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def byte_bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe_codec.encode_digests(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mix", mix_stage),
    ("byte_bpe", byte_bpe_stage),
]

#: Training, hashing and tokenising can't be said in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
