"""Joins with stated null and uniqueness rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join in which null keys meet. Still a hash or merge join: <=> is an equality to Catalyst."""
    r = right.select(*[F.col(k).alias(f"__r_{k}") if k in keys else F.col(k) for k in right.columns])
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(r[f"__r_{k}"]) for k in keys])
    return left.join(r, on, how).drop(*[f"__r_{k}" for k in keys])


def fallback_union(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the second source for keys that the first lacks."""
    return first.unionByName(second.join(first.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def violations(facts: DataFrame, key: str, dimension: DataFrame, dimension_key: str) -> DataFrame:
    """Facts whose key the dimension lacks; null keys are no violation."""
    d = dimension.select(F.col(dimension_key).alias("__k"))
    return facts.filter(F.col(key).isNotNull()).join(d, F.col(key) == F.col("__k"), "left_anti")


def match_unique(left: DataFrame, dimension: DataFrame, keys: list[str], code: str, out: str = "match") -> DataFrame:
    """Attaches the code where the dimension has the key once: exato, ambiguo (more often) or sem_match."""
    per_key = dimension.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.min(code).alias("__code"))
    joined = left.join(per_key, keys, "left")
    kind = F.when(F.col("__n") == 1, "exato").when(F.col("__n") > 1, "ambiguo").otherwise("sem_match")
    return joined.withColumns({code: F.when(F.col("__n") == 1, F.col("__code")), out: kind}).drop("__n", "__code")


def membership(df: DataFrame, key: str, members: DataFrame, member_key: str, out: str) -> DataFrame:
    """A flag for whether the key is in the other table; never multiplies rows."""
    m = members.select(F.col(member_key).alias("__m")).distinct().withColumn("__hit", F.lit(True))
    return df.join(m, F.col(key) == F.col("__m"), "left").withColumn(out, F.coalesce("__hit", F.lit(False))).drop("__m", "__hit")


def keeps_rows(before: DataFrame, after: DataFrame) -> None:
    a, b = before.count(), after.count()
    if a != b:
        raise AssertionError(f"the join changed {a} rows to {b}")


def with_literals(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A relation of literal rows; small by construction, so it may be broadcast."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def rule_priority(candidates: DataFrame, keys: list[str], rule: Column, code: str) -> DataFrame:
    """The code of the best rule (least number) if it names one only; else null."""
    ranked = candidates.withColumn("__rule", rule).filter(F.col("__rule").isNotNull())
    per_rule = ranked.groupBy(*keys, "__rule").agg(F.countDistinct(code).alias("__n"), F.min(code).alias("__code"))
    best = per_rule.filter("__n = 1").groupBy(*keys).agg(F.min_by("__code", "__rule").alias(code))
    return candidates.select(*keys).distinct().join(best, keys, "left")
