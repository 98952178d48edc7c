"""Operator 2: mixing sources to target weights.

Each document gets a hash-random key. The documents are range-sorted by source and key,
and a distributed prefix sum of sizes (sums of each partition, then offsets, then running
sums within partitions) places every document in its source's sequence of words. A source's
budget is cut exactly: whole epochs for all its documents, and what is left for those
that stand first in the sequence; the document on the cut gives only part of its words.

Weights go 1, 2, 3, repeating, over the sources by code point, null last. Targets share the
total size by weight; no target exceeds ``max_epochs`` times its source's size, the
excess going to the others by weight.

Defined results: null text has size 0, null source is a source of its own; a source of size
0 has target 0; an empty table gives no rows. Repeated rows count each by itself. The key
depends on doc_id and text alone, so reruns and other partitionings agree. Extra columns
are ignored (mix) or kept (mix_documents).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, n_words

MAX_EPOCHS = 3
WEIGHTS = 3


def random_key(doc_id: Column, text: Column, seed: int = 17) -> Column:
    return F.xxhash64(F.lit(seed), doc_id, F.xxhash64(text))


def source_targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Rows (source, source_size, target) from rows (source, size).

    With caps sorted by cap / weight, the capped sources come first; a source is capped if
    what is left for it and those after it, by weight, passes its cap. The windows run over one
    row per source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = everything.rowsBetween(Window.unboundedPreceding, -1)
    after = everything.rowsBetween(0, Window.unboundedFollowing)
    ranked = (
        per.withColumn("rank", F.row_number().over(by_name))
        .withColumn("weight", ((F.col("rank") - 1) % WEIGHTS + 1).cast("double"))
        .withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
        .withColumn("total", F.sum("source_size").over(Window.partitionBy(F.lit(0))).cast("double"))
        .withColumn("share", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
        .withColumn("open", F.col("cap") >= F.col("share") * F.col("weight"))
    )
    share = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), "rank", "share"))).over(Window.partitionBy(F.lit(0)))["share"]
    return ranked.withColumn("level", share).select(
        "source", "source_size", F.when(F.col("open"), F.col("weight") * F.col("level")).otherwise(F.col("cap")).alias("target")
    )


def prefix_sums(sizes: DataFrame, name: str = "prefix") -> DataFrame:
    """Adds ``prefix``: the sizes of the source's rows that come before by (key, doc_id).

    sizes: doc_id, source, size, key. Rows of one source may lie in many partitions."""
    n = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(parts):
        from pyspark import TaskContext

        part_no, current, at = TaskContext.get().partitionId(), None, 0
        for pdf in parts:
            null = pdf["source"].isna().to_numpy()
            name_ = pdf["source"].fillna("").to_numpy()
            size = pdf["size"].to_numpy(np.int64)
            new = np.ones(len(pdf), bool)
            new[1:] = (name_[1:] != name_[:-1]) | (null[1:] != null[:-1])
            first = np.flatnonzero(new)
            local = np.cumsum(size) - size
            for a, b in zip(first, [*first[1:], len(pdf)]):
                own = (name_[a], bool(null[a]))
                at = at if own == current else 0
                current = own
                local[a:b] += at - local[a]
                at = int(local[b - 1] + size[b - 1])
            yield pd.DataFrame({**{c: pdf[c] for c in ("doc_id", "source", "size", "key")}, "part_no": np.int32(part_no), "local": local})

    placed = (
        sizes.select("doc_id", "source", "size", "key")
        .repartitionByRange(n, F.col("source").asc_nulls_last(), "key", "doc_id")
        .sortWithinPartitions(F.col("source").asc_nulls_last(), "key", "doc_id")
        .mapInPandas(run, "doc_id long, source string, size long, key long, part_no int, local long")
    )
    placed = materialize(placed, name)
    # A row for each source and partition that it lies in: partitions plus sources at most.
    sums = placed.groupBy("source", "part_no").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("source").orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("source").alias("s"), F.col("part_no").alias("p"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    joined = placed.join(offsets, placed["source"].eqNullSafe(offsets["s"]) & (placed["part_no"] == offsets["p"]))
    return joined.select("doc_id", "source", "size", "key", (F.col("local") + F.col("offset")).alias("prefix"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"), docs[source_col].cast("string").alias("source"),
        n_words(docs[text_col]).alias("size"), random_key(docs[id_col], docs[text_col]).alias("key"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken, source), one per document."""
    sizes = materialize(_sized(docs, id_col, text_col, source_col), "sizes")
    targets = materialize(source_targets(sizes, max_epochs), "targets").withColumnRenamed("source", "s")
    placed = prefix_sums(sizes)
    budget = F.round("target").cast("long")
    left = F.expr("if(source_size = 0, 0, budget % source_size)")
    epochs = F.expr("if(source_size = 0, 0, budget div source_size)")
    part = F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("prefix")))
    return (
        placed.join(targets, placed["source"].eqNullSafe(targets["s"]))
        .withColumn("budget", budget)
        .select("doc_id", "size", "source_size", "target", (F.col("size") * epochs + part).cast("long").alias("taken"), "source")
    )


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as the mix takes it.

    Whole documents only: the one on a source's cut comes in if at least half of it is within
    the budget. Each source's cut is a key, so the rows need no join by id."""
    sizes = materialize(_sized(docs, id_col, text_col, source_col), "sizes")
    targets = materialize(source_targets(sizes, max_epochs), "targets").withColumnRenamed("source", "s")
    placed = prefix_sums(sizes)
    plan = placed.join(targets, placed["source"].eqNullSafe(targets["s"])).withColumn("budget", F.round("target").cast("long"))
    left = F.expr("if(source_size = 0, 0, budget % source_size)")
    inside = (left > 0) & (2 * F.col("prefix") + F.col("size") <= 2 * left)
    cuts = plan.groupBy(F.col("source").alias("s")).agg(
        F.max(F.expr("if(source_size = 0, 0, budget div source_size)")).alias("epochs"),
        F.max(F.when(inside, F.struct("key", "doc_id"))).alias("last"),
    )
    cuts = materialize(cuts, "cuts")
    d = docs.withColumn("__key", random_key(docs[id_col], docs[text_col]))
    joined = d.join(cuts, d[source_col].cast("string").eqNullSafe(cuts["s"]), "left")
    once_more = F.coalesce(F.struct(F.col("__key"), docs[id_col].cast("long")) <= F.col("last"), F.lit(False))
    copies = F.coalesce(F.col("epochs"), F.lit(0)).cast("int") + once_more.cast("int")
    return joined.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), copies))).select(*[docs[c] for c in docs.columns])
