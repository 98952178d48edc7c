"""Small-count suppression as named policies: they differ in what a null count means."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_count(df: DataFrame, n: str, metrics: list[str], n_min: int, flag: str = "suprimido") -> DataFrame:
    """Aggregate policy: a null count suppresses; the metrics become null, the count stays."""
    hidden = F.coalesce(F.col(n), F.lit(0)) < n_min
    return df.withColumns({flag: hidden, **{m: F.when(~hidden, F.col(m)) for m in metrics}})


def by_own_base(df: DataFrame, bases: dict[str, str], n_min: int, null_base_hides: bool = False) -> DataFrame:
    """Each metric against its own count (metric -> count column); a null count keeps it unless told otherwise."""
    missing = 0 if null_base_hides else n_min
    return df.withColumns({m: F.when(F.coalesce(F.col(b), F.lit(missing)) >= n_min, F.col(m)) for m, b in bases.items()})


def inherited(df: DataFrame, metrics: list[str], flag: str = "suprimido") -> DataFrame:
    """Suppressed by the publisher: all metrics are null."""
    return df.withColumn(flag, F.coalesce(*[F.col(m).cast("string") for m in metrics]).isNull())


def publishable_count(df: DataFrame, n: str, flag: str = "suprimido", out: str = "n_publicavel") -> DataFrame:
    return df.withColumn(out, F.when(~F.col(flag), F.col(n)))


def serving_cells(df: DataFrame, code: str, value: str, n: str, n_min: int, digits: int = 2) -> DataFrame:
    """Cells (codigo, valor, n, suprimido): a null value or a known small count suppresses, a null count doesn't."""
    hidden = F.col(value).isNull() | F.coalesce(F.col(n) < n_min, F.lit(False))
    return df.select(
        F.col(code).alias("codigo"), F.when(~hidden, F.bround(F.col(value), digits)).alias("valor"),
        F.col(n).cast("long").alias("n"), hidden.alias("suprimido"),
    )


def masked_count(n: Column, n_min: int = 10) -> Column:
    return F.when(n < n_min, F.lit(f"<{n_min}")).otherwise(n.cast("string"))


def violations(df: DataFrame, metrics: list[str], flag: str = "suprimido") -> DataFrame:
    """Rows that are suppressed and still have a metric."""
    any_value = reduce(lambda a, b: a | b, [F.col(m).isNotNull() for m in metrics])
    return df.filter(F.col(flag) & any_value)


def visible_weighted_mean(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Weighted mean over cells that kept their value."""
    w = F.when(F.col(value).isNotNull(), F.col(weight))
    total = F.sum(w)
    return df.groupBy(*keys).agg(F.try_divide(F.sum(F.col(value) * w), total).alias("valor"), total.alias("n"))
