"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is an aggregation and a join on the node; the rounds are logarithmic in practice.
Nothing but two numbers a round comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import Scratch, materialize


def _star(edges: DataFrame, large: bool, scratch: Scratch) -> DataFrame:
    """edges (u, v), u > v. Large: larger neighbours go to the least; small: lesser ones do."""
    both = edges.select("u", "v")
    if large:
        both = both.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # Written first, so that both sides of the join are plain exchanges: a hub's rows can then be split.
    least = scratch.keep(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m")), "least")
    joined = both.join(least, "u")
    if large:
        moved = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.filter(F.col("u") > F.col("v")).distinct()


def _kept(scratch: Scratch, edges: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """The edges as a table, and their number and the sum of their hashes, taken while they are written."""
    seen = Observation()
    kept = scratch.keep(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), name)
    return kept, (seen.get["n"], seen.get["h"])


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root), root the least node that the node reaches; roots themselves are left out.

    edges: rows (u, v) of longs, any order, repeats and loops allowed."""
    with Scratch(edges.sparkSession) as scratch:
        edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()
        now, state = _kept(scratch, edges, "edges")
        while state[0]:
            before = state
            now, state = _kept(scratch, _star(scratch.keep(_star(now, True, scratch), "large"), False, scratch), "small")
            scratch.drop(1)
            if state == before:
                break
        return materialize(now.select(F.col("u").alias("node"), F.col("v").alias("root")), "components")
