"""Helpers shared by the corpus operators: tables, shared scratch space, text rules."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space in every text rule of this subpackage: space, tab, LF, VT, FF, CR.
WS = " \t\n\x0b\x0c\r"
#: A word, as a Java regular expression.
WORD_RE = r"[^\x20\x09-\x0D]+"

_scratch: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that setting is absent (local tests) a folder is made and set."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jvm_dir.isDefined():
        return jvm_dir.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by driver and executors")
    made = "file://" + tempfile.mkdtemp(prefix="meridia-ckpt-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def _drop(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def clear_scratch() -> None:
    """Deletes the tables of materialize(); runs at exit, or when a driver calls it."""
    spark = SparkSession.getActiveSession()
    while _scratch:
        path = _scratch.pop()
        try:
            if spark is not None:
                _drop(spark, path)
        except Exception:  # the session may already be gone at exit
            pass


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/meridia/{name}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it again.

    It cuts the lineage: after the loss of an executor, later stages read the files
    instead of computing ``df`` anew."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(df_paths: list[str], spark: SparkSession) -> None:
    """Deletes scratch tables that no pending DataFrame reads any longer."""
    for path in df_paths:
        if path in _scratch:
            _scratch.remove(path)
            _drop(spark, path)


class Scratch:
    """Tables of materialize() that are deleted on leaving the ``with`` block."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def keep(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        kept = materialize(df, name, partition_by)
        self.paths.append(_scratch[-1])
        return kept

    def drop(self, n: int) -> None:
        """Deletes all but the n newest tables."""
        old, self.paths = self.paths[: len(self.paths) - n], self.paths[len(self.paths) - n :]
        drop_scratch(old, self.spark)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop(0)


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def row_key(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """Two hashes that tell a row apart by its id and text."""
    doc_id = doc_id.cast("long")
    return F.xxhash64(doc_id, text), F.xxhash64(F.lit(7), text, doc_id)


def n_words(col):
    """Number of words; null counts as none."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD_RE)), F.lit(0)).cast("long")


def bounded_sample(rows: DataFrame, group: str, hashed: str, k: int) -> DataFrame:
    """At most k rows of each group (null is one), those with the least of a column of hashes.

    The group's count first gives a threshold that about 3 k rows pass, so that no task ranks
    more than those, however large the group is."""
    sizes = rows.groupBy(F.col(group).alias("__g")).agg(F.count(F.lit(1)).alias("__n"))
    near = rows.join(sizes, F.col(group).eqNullSafe(F.col("__g")))
    near = near.filter(F.col(hashed) / float(1 << 63) < 6.0 * k / F.col("__n") - 1).drop("__g", "__n")
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*[F.col(c) for c in dict.fromkeys([hashed, *rows.columns])]))
    return near.withColumn("__rank", rank).filter(F.col("__rank") <= k).drop("__rank")
