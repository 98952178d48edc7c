"""Operator 8 [native]: exact dedup with a heavy-hitter split.

Copies are rows whose texts have equal SHA-256 after all white space is deleted.
A Misra-Gries pass (Spark's ``freqItems`` aggregate) names at most ``1 / support``
digests that may hold more than ``support`` of the rows; one exact count verifies
them. The winners (a table of at most ``1 / support`` rows) are broadcast, so that
rows of huge groups never meet in a shuffle; every other group holds at most
``support`` of the rows and takes the ordinary shuffle on its digest, aggregated before it.

Defined results: null text counts as empty; all empty texts are one group; the row
with the longest original text stays, then the smallest doc_id (null last); of
rows that agree in both, exactly one stays. An empty table gives an empty result.
Only the named id and text columns are read, so extra columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS, materialize, text_or_empty


def digest_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row per document: all that later steps need; texts are read once."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.sha2(F.translate(text_or_empty(text_col), WS, "").cast("binary"), 256).alias("digest"),
        F.length(text_or_empty(text_col)).cast("long").alias("n_cp"),
        F.monotonically_increasing_id().alias("row_no"),
    )


def _winner():
    """The row that stays is the smallest of these."""
    return F.min(F.struct((-F.col("n_cp")).alias("neg_cp"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_no"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = 0.001) -> DataFrame:
    """Rows (doc_id, keep_id, group_size, kept, text_sha256), one per input row."""
    rows = materialize(digest_table(docs, id_col, text_col), "digests")
    likely = rows.stat.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    # At most 1 / support rows, by construction of Misra-Gries; the count makes them certain.
    counted = rows.join(F.broadcast(likely), "digest").groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), _winner().alias("w"))
    total = rows.count()
    winners = materialize(counted.filter(F.col("group_size") > max(1, int(total * support))), "winners")
    hot = rows.join(F.broadcast(winners), "digest")
    rest = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    # Groups are counted before the shuffle, then joined row by row: no task holds a group.
    groups = rest.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), _winner().alias("w"))
    rest = rest.join(groups, "digest")
    return hot.unionByName(rest).select(
        "doc_id",
        F.col("w.doc_id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("row_no") == F.col("w.row_no")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
