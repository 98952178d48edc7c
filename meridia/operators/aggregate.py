"""Aggregates whose treatment of nulls is part of their meaning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Decimals that exact_mean takes in, and the size below which they are exact in a double.
_DECIMALS, _EXACT = 10_000, 9e11


def exact_mean(value: Column) -> Column:
    """Mean of doubles of at most four decimals (amounts), summed as whole numbers.

    So it doesn't depend on the order of rows, and groups of equal means tie wherever their rows lie. A group with
    another value (more decimals, very large, not finite) has the plain mean."""
    whole = F.when(F.abs(value) < _EXACT, F.rint(value * _DECIMALS)).cast("long")
    fits = F.coalesce(F.bool_and(value.isNull() | F.coalesce(whole / _DECIMALS == value, F.lit(False))), F.lit(False))
    total = F.sum(whole.cast("decimal(19,0)")).cast("double")
    return F.when(fits, F.try_divide(total, F.count(value).cast("double") * _DECIMALS)).otherwise(F.avg(value))


def percent(predicate: Column, where: Column | None = None) -> Column:
    """100 times the share of true; null predicates don't count, nor do rows outside ``where``."""
    value = predicate.cast("double")
    return 100.0 * F.avg(value if where is None else F.when(where, value))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Rows without a value carry no weight; null if no weight is left."""
    w = F.when(value.isNotNull(), weight.cast("double"))
    return F.try_divide(F.sum(value * w), F.when(F.sum(w) != 0, F.sum(w)))


def weighted_mean_null_as_zero(value: Column, weight: Column) -> Column:
    """Null values count as 0 under the full weight: the literal form of the published tables."""
    w = F.coalesce(weight.cast("double"), F.lit(0.0))
    return F.try_divide(F.sum(F.coalesce(value, F.lit(0.0)) * w), F.when(F.sum(w) != 0, F.sum(w)))


def mean_of_all(*columns: Column) -> Column:
    """Row-wise mean; null as soon as one is null."""
    return reduce(lambda a, b: a + b, columns) / len(columns)


def mean_of_known(*columns: Column) -> Column:
    """Row-wise mean of what is not null."""
    known = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in columns])
    return F.try_divide(reduce(lambda a, b: a + b, [F.coalesce(c.cast("double"), F.lit(0.0)) for c in columns]), F.when(known > 0, known))


def last_known(value: Column, order: Column) -> Column:
    """The last value that is not null, so columns of one group may come from different rows."""
    return F.max_by(F.when(value.isNotNull(), value), F.when(value.isNotNull(), order))


def first_known(value: Column, order: Column) -> Column:
    return F.min_by(F.when(value.isNotNull(), value), F.when(value.isNotNull(), order))


def null_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (coluna, pct_nulo) for all columns, in one pass."""
    one = df.agg(*[(100.0 * F.avg(F.col(c).isNull().cast("double"))).alias(c) for c in columns])
    return one.unpivot([], columns, "coluna", "pct_nulo")


def share_of_total(df: DataFrame, keys: list[str], within: list[str] | None = None) -> DataFrame:
    """Counts by key and their share of the total (of a group of keys)."""
    over = Window.partitionBy(*(within or [F.lit(0)]))
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("pct", 100.0 * F.col("n").cast("double") / F.sum("n").over(over))


def pivot_counts(df: DataFrame, keys: list[str], column: str, names: dict[str, str]) -> DataFrame:
    """Counts of the named values as columns, 0 where there is none. Conditional sums: one shuffle, no value scan."""
    return df.groupBy(*keys).agg(*[F.count(F.when(F.col(column) == v, 1)).alias(n) for v, n in names.items()])


def melt(df: DataFrame, keys: list[str], metrics: list[str], flag: str = "suprimido") -> DataFrame:
    """Long rows (keys, suprimido, metrica, valor): suppressed cells stay, plain nulls go."""
    long = df.select(*keys, flag, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot([*keys, flag], metrics, "metrica", "valor")
    return long.filter(F.col("valor").isNotNull() | F.col(flag))


def without_null_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Grouping that leaves null keys out, as opposed to Spark's."""
    return df.dropna(subset=keys)


def with_total(df: DataFrame, label: str, metrics: list[str], name: str = "total") -> DataFrame:
    """A grand-total row below a table of sums."""
    total = df.agg(*[F.sum(m).alias(m) for m in metrics]).withColumn(label, F.lit(name))
    return df.select(label, *metrics).unionByName(total.select(label, *metrics))


def coverage(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Percentage of rows that have each column, by key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("linhas"), *[percent(F.col(c).isNotNull()).alias(f"pct_{c}") for c in columns])


def rate_per_100k(dimension: DataFrame, counts: DataFrame, key: str, group: str, population: str, n: str = "n") -> DataFrame:
    """Counts over inhabitants by group, over the whole dimension: places without a count have 0."""
    joined = dimension.join(counts, key, "left").withColumn("__n", F.coalesce(F.col(n), F.lit(0)))
    return joined.groupBy(group).agg(F.sum("__n").alias("n"), (F.sum("__n") / F.sum(population) * 1e5).alias("taxa_100k"))


def ratio_means(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    return df.groupBy(*keys).agg(weighted_mean(F.col(value), F.col(weight)).alias("valor"), F.sum(F.when(F.col(value).isNotNull(), F.col(weight))).alias("n"))


def wide_metrics(df: DataFrame, keys: list[str], column: str, values: list[str], metrics: list[str]) -> DataFrame:
    """metric_value columns from long rows; named values only, so no scan for them."""
    return df.groupBy(*keys).agg(*[F.avg(F.when(F.col(column) == v, F.col(m))).alias(f"{m}_{v}") for v in values for m in metrics])
