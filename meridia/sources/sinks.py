"""Sinks. All writes go through Spark's committers; the driver only ever writes small reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parquet(df: DataFrame, path: str, sort: list[str] | None = None, partition_by: list[str] | None = None) -> None:
    """zstd, fully rewritten. Sorting is within files, which is what readers prune by."""
    if sort:
        df = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append_edition(df: DataFrame, path: str, year: str = "ano") -> None:
    """Replaces the partitions that the rows belong to, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(year).parquet(path)


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def json_slices(df: DataFrame, path: str, by: list[str]) -> None:
    df.write.mode("overwrite").partitionBy(*by).json(path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def labels_once(df: DataFrame, path: str, label: str) -> bool:
    """Writes a sample for people to label, unless one that has labels is there. True if it was written."""
    spark = df.sparkSession
    if _exists(spark, path) and spark.read.csv(path, header=True).filter(F.trim(F.coalesce(label, F.lit(""))) != "").limit(1).count():
        return False
    csv(df, path)
    return True


def markdown(df: DataFrame, limit: int = 1000) -> str:
    """A small table as text; one of more than ``limit`` rows is refused, not cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"the table has more than {limit} rows")
    show = lambda v: "" if v is None else f"{v:.3f}".rstrip("0").rstrip(".") if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(show, r)) + " |" for r in rows])


def key_values(df: DataFrame, key: str, value: str, send, max_bytes: int = 700_000) -> None:
    """Sends (key, value) pairs in batches of bounded size, from the executors. send(list of pairs) must be repeatable."""

    def run(rows):
        batch, size = [], 0
        for r in rows:
            n = len(r[key]) + len(r[value].encode())
            if batch and size + n > max_bytes:
                send(batch)
                batch, size = [], 0
            batch.append((r[key], r[value]))
            size += n
        if batch:
            send(batch)

    df.select(key, value).foreachPartition(run)


def versioned(tables: dict[str, DataFrame], root: str, version: str) -> None:
    """Each table as Parquet and CSV below root/version; CSV only of columns that it can hold."""
    for name, df in tables.items():
        parquet(df, f"{root}/{version}/parquet/{name}")
        flat = [c for c, t in df.dtypes if not t.startswith(("array", "map", "struct"))]
        csv(df.select(*flat), f"{root}/{version}/csv/{name}")
