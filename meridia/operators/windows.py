"""Ranks, positions, bins and picks over windows. Every order has a tiebreak, so results don't depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_row(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each group by the order (give descending columns for the latest)."""
    return top_k(df, keys, 1, *order)


def top_k(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """Spark limits ranks before the shuffle too, so large groups cost k rows a task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= k).drop("__rn")


def competition_rank(df: DataFrame, keys: list[str], value: str, out: str = "posicao") -> DataFrame:
    """1, 2, 2, 4, highest first; null values have no rank."""
    w = Window.partitionBy(*keys, F.col(value).isNull()).orderBy(F.col(value).desc())
    return df.withColumn(out, F.when(F.col(value).isNotNull(), F.rank().over(w)))


def average_rank(value: str, keys: list[str], descending: bool = False) -> Column:
    """Rank within groups, ties sharing their mean; null stays null and counts for nothing. Whole tables: global_rank."""
    part = [*keys, F.col(value).isNull()]
    col = F.col(value)
    first = F.rank().over(Window.partitionBy(*part).orderBy(col.desc() if descending else col))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*part, col))
    return F.when(col.isNotNull(), first + (ties - 1) / 2)


def percent_rank(value: str, keys: list[str]) -> Column:
    """Average rank over the number of values that are not null."""
    total = F.count(value).over(Window.partitionBy(*keys))
    return average_rank(value, keys) / total


def rank_table(df: DataFrame, value: str, out: str, descending: bool = False, percent: bool = False) -> DataFrame:
    """Rows (__v, out): the average rank (or its share) of each distinct value, without one task for all rows.

    Counts of distinct values are range-sorted; a value's rank is its partition's offset plus what
    comes before it there. The counts are kept, as both readings must see the same partitions."""
    order = F.col(value).desc() if descending else F.col(value).asc()
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("__c"))
    placed = counts.repartitionByRange(order).sortWithinPartitions(order).withColumn("__p", F.spark_partition_id()).persist()
    whole = Window.orderBy("__p")  # one row for each partition
    sums = placed.groupBy("__p").agg(F.sum("__c").alias("__s"))
    offsets = sums.select("__p", (F.sum("__s").over(whole.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__s")).alias("__o"), F.sum("__s").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__all"))
    upto = F.sum("__c").over(Window.partitionBy("__p").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    place = F.col("__o") + F.col("__upto") - (F.col("__c") - 1) / 2
    return placed.withColumn("__upto", upto).join(offsets, "__p").select(F.col(value).alias("__v"), (place / F.col("__all") if percent else place).alias(out))


def with_ranks(df: DataFrame, value: str, ranks: DataFrame) -> DataFrame:
    return df.join(ranks, F.col(value) == F.col("__v"), "left").drop("__v")


def global_rank(df: DataFrame, value: str, out: str, descending: bool = False, percent: bool = False) -> DataFrame:
    """average_rank (or percent_rank) over a whole table."""
    return with_ranks(df, value, rank_table(df, value, out, descending, percent))


def global_min_max(df: DataFrame, value: str, out: str) -> DataFrame:
    limits = df.agg(F.min(value).alias("__low"), F.max(value).alias("__high"))
    scaled = F.try_divide(F.col(value) - F.col("__low"), F.col("__high") - F.col("__low"))
    return df.crossJoin(F.broadcast(limits)).withColumn(out, scaled).drop("__low", "__high")


def min_max(value: str, keys: list[str]) -> Column:
    w = Window.partitionBy(*keys)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.try_divide(F.col(value) - low, high - low)


def occurrence_index(df: DataFrame, same: list[str], row_id: str, out: str = "ocorrencia") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*same).orderBy(row_id)) - 1)


def duplicate_flag(df: DataFrame, same: list[str], row_id: str, out: str = "linha_duplicada") -> DataFrame:
    """True for all but the first of equal rows."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*same).orderBy(row_id)) > 1)


def group_size(df: DataFrame, keys: list[str], out: str = "n_grupo") -> DataFrame:
    return df.withColumn(out, F.count(F.lit(1)).over(Window.partitionBy(*keys)))


def ambiguous_flag(df: DataFrame, keys: list[str], out: str = "ambiguo") -> DataFrame:
    return df.withColumn(out, F.count(F.lit(1)).over(Window.partitionBy(*keys)) > 1)


def runner_up_margin(df: DataFrame, keys: list[str], score: str, tiebreak: str, out: str = "margem") -> DataFrame:
    """The best row of each group with its lead over the second (over 0 if there is none)."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), tiebreak)
    both = df.withColumns({"__rn": F.row_number().over(w), out: F.col(score) - F.coalesce(F.lead(score).over(w), F.lit(0.0))})
    return both.filter("__rn = 1").drop("__rn")


def position_in_group(df: DataFrame, keys: list[str], value: str, hidden: str = "suprimido") -> DataFrame:
    """posicao of total among the cells that are shown; hidden ones have neither rank nor weight."""
    shown = ~F.col(hidden) & F.col(value).isNotNull()
    w = Window.partitionBy(*keys, shown)
    return df.withColumns({
        "posicao": F.when(shown, F.rank().over(w.orderBy(F.col(value).desc()))),
        "total": F.when(shown, F.count(F.lit(1)).over(w)),
    })


def quantile_classes(df: DataFrame, keys: list[str], value: str, classes: int = 5, out: str = "classe") -> DataFrame:
    """Classes by interpolated quantiles; a value on a threshold belongs above it. Thresholds are one row a group."""
    cuts = [i / classes for i in range(1, classes)]
    limits = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.percentile(value, F.array(*map(F.lit, cuts))).alias("__cuts"))
    joined = df.join(limits, keys, "left")
    above = F.size(F.filter("__cuts", lambda c: F.col(value) >= c))
    return joined.withColumn(out, F.when(F.col(value).isNotNull(), above + 1)).drop("__cuts")


def right_closed_bands(c: Column, edges: list[float], labels: list[str]) -> Column:
    """(edge, next] bands; outside or null: the text nan, as the published tables have it."""
    out = F.lit("nan")
    for low, high, label in reversed(list(zip(edges[:-1], edges[1:], labels))):
        out = F.when((c > low) & (c <= high), label).otherwise(out)
    return out


def score_bands(c: Column, cuts: tuple[float, ...] = (80, 85, 90, 95, 100)) -> Column:
    """[low, high) bands, the top score by itself."""
    out = F.when(c >= cuts[-1], f"{cuts[-1]:g}")
    for low, high in reversed(list(zip(cuts[:-1], cuts[1:]))):
        out = out.when((c >= low) & (c < high), f"{low:g}-<{high:g}")
    return F.when(c.isNull(), "nan").otherwise(out.otherwise(f"<{cuts[0]:g}"))


def top_share_or_member(df: DataFrame, keys: list[str], value: str, members: DataFrame, member_key: str, share: float = 0.9) -> DataFrame:
    """destaque: at or above the group's quantile, or in the members' set."""
    cut = df.groupBy(*keys).agg(F.percentile(value, share).alias("__cut"))
    inside = members.select(member_key).distinct().withColumn("__in", F.lit(True))
    joined = df.join(cut, keys, "left").join(inside, member_key, "left")
    member = F.coalesce("__in", F.lit(False))
    top = F.coalesce(F.col(value) >= F.col("__cut"), F.lit(False))
    return joined.withColumns({"membro": member, "destaque": top | member}).drop("__cut", "__in")


def stratified_sample(df: DataFrame, strata: str, sizes: dict[str, int], key: str, seed: int = 42, total: int | None = None, prefer: tuple[str, ...] = ()) -> DataFrame:
    """A fixed number of rows of each stratum, by hash order; what is missing to the total comes from preferred strata."""
    order = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))
    rank = F.row_number().over(Window.partitionBy(strata).orderBy(order, key))
    wanted = F.lit(0)
    for name, n in sizes.items():
        wanted = F.when(F.col(strata) == name, n).otherwise(wanted)
    ranked = df.withColumn("__rank", rank).withColumn("__wanted", wanted)
    picked = ranked.filter("__rank <= __wanted")
    if total is not None and prefer:
        place = F.lit(len(prefer))
        for i, name in reversed(list(enumerate(prefer))):
            place = F.when(F.col(strata) == name, i).otherwise(place)
        spare = ranked.filter("__rank > __wanted").withColumn("__place", place).filter(F.col("__place") < len(prefer))
        missing = total - picked.count()
        if missing > 0:
            picked = picked.unionByName(spare.orderBy("__place", order, key).limit(missing).drop("__place"))
    return picked.drop("__rank", "__wanted")


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """One page of an ordered table; page numbers below 1 are the first."""
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)
