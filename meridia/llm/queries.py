"""Registered queries of the corpus operators: production parameters, whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe_codec, exact_dedup, lang_id, line_dedup, mixing, quality, secrets, simhash, token_store
from .common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.predict(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_store(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe_codec.encode_digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_mixing": op2_mixing,
    "op3_token_store": op3_token_store,
    "op4_nearest_neighbours": op4_nearest_neighbours,
    "op5_quality": op5_quality,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_line_dedup": op7_line_dedup,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_secrets": op9_secrets,
    "op10_simhash": op10_simhash,
}

ORACLE_SQL: dict[str, str] = {
    "op7_line_dedup": r"""
        WITH lines AS (
          SELECT doc_id, u.pos, u.line, lower_key.k
          FROM (SELECT doc_id, unnest(list_zip(string_split(coalesce(text, ''), chr(10)),
                                      range(len(string_split(coalesce(text, ''), chr(10)))))) AS z FROM documents),
               LATERAL (SELECT z[1] AS line, z[2] AS pos) u,
               LATERAL (SELECT translate(regexp_replace(u.line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                                         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k) lower_key),
        frequent AS (
          SELECT k, max(doc_id) AS last_doc FROM lines WHERE length(k) >= 40
          GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
        marked AS (
          SELECT l.doc_id, l.pos, l.line, f.k IS NOT NULL AND l.doc_id <> f.last_doc AS dropped
          FROM lines l LEFT JOIN frequent f ON l.k = f.k)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
        FROM marked GROUP BY doc_id
    """,
    "op8_exact_dedup": r"""
        WITH d AS (
          SELECT doc_id, coalesce(text, '') AS t,
                 sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
          FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY h) AS group_size,
               row_number() OVER w = 1 AS kept,
               h AS text_sha256
        FROM d
        WINDOW w AS (PARTITION BY h ORDER BY length(t) DESC, doc_id NULLS LAST)
    """,
    "op9_secrets": r"""
        WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, source, coalesce(text, '') AS t FROM documents),
        m AS (
          SELECT row_no, 0 AS kind, 8 AS least, t, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)' AS p, 2 AS g FROM d
          UNION ALL SELECT row_no, 1, 16, t, '(AKIA[A-Z0-9]+)()', 1 FROM d
          UNION ALL SELECT row_no, 2, 32, t, '([0-9a-f]+)()', 1 FROM d
          UNION ALL SELECT row_no, 3, 20, t, '([A-Za-z0-9_-]{20,})()', 1 FROM d),
        l AS (
          SELECT row_no, kind, least, regexp_extract_all(t, p, 0) AS ms, string_split_regex(t, p) AS gaps,
                 CASE WHEN g = 2 THEN regexp_extract_all(t, p, 2) ELSE regexp_extract_all(t, p, 1) END AS vs FROM m),
        u AS (SELECT row_no, kind, least, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS mt, unnest(vs) AS v, unnest(gaps[1:len(ms)]) AS gap FROM l),
        w AS (SELECT row_no, kind, least, i, mt, v, sum(length(gap) + length(mt)) OVER (PARTITION BY row_no, kind ORDER BY i) AS stop FROM u),
        s AS (
          SELECT row_no, kind, v, stop - length(mt) AS start, stop FROM w
          WHERE length(v) >= least AND (kind < 3 OR regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[0-9]'))),
        f AS (
          SELECT v, count(DISTINCT coalesce('s' || source, '')) <= 2 AND count(DISTINCT {'o': source, 'd': doc_id}) <= 10 AS live
          FROM s JOIN d USING (row_no) GROUP BY v),
        x AS (
          SELECT s.*, live, concat_ws(':', ['assign', 'access', 'hex', 'token'][kind + 1], start, stop) AS shown,
                 kind < 3 OR live AND NOT EXISTS (SELECT 1 FROM s AS b WHERE b.row_no = s.row_no AND b.kind < 3 AND b.start < s.stop AND s.start < b.stop) AS counts
          FROM s JOIN f USING (v)),
        r AS (
          SELECT row_no, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
                 string_agg(shown, ',' ORDER BY start, kind) FILTER (WHERE kind < 3) AS base, string_agg(shown, ',' ORDER BY start, kind) FILTER (WHERE counts) AS spans,
                 count(*) FILTER (WHERE kind < 3 AND live) AS n_live, count(*) FILTER (WHERE kind < 3 AND NOT live) AS n_copied
          FROM x GROUP BY row_no)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
               coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
        FROM d LEFT JOIN r USING (row_no)
    """,
}
