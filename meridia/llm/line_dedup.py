"""Operator 7: line dedup over levelled sorted runs of line hashes.

A line's key is the line without white space at both ends and with A-Z lower-cased; keys
of at least MIN_CHARS code points take part. A run is a bucketed and sorted table of
(h1, h2, n_docs, last_doc) by the 128-bit hash of the key. Documents come in batches of descending
doc_id. A batch's keys, dealt and sorted once like the runs, merge-anti-join the runs: keys that are new have
their last document in this batch; the others only add to a count. Both make one run of level 0; as soon as
a level holds FANOUT runs, they are compacted into one run of the next level. Joins and compaction of runs need no
exchange, as all have the same buckets. A line is dropped if the runs hold its key for at least MIN_DOCS documents
and it is not in the last of them.

The HOT_KEYS keys of most documents are broadcast, so that no key's lines meet in one task; any other key has at most
a HOT_KEYS-th of all lines.

Defined results: null or empty text is one empty line, which is too short to go; documents are distinct doc_ids
(rows that share one count as one document, and so do all rows without); rows that share the largest doc_id all
keep the line, null doc_id is smaller than any other; no rows, no result; time and memory are linear in a text's
length. Other columns may have any name. drop_lines keeps all columns and sets n_chars, where there is such
a column, to the new length.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS, Scratch, drop_scratch, materialize, scratch_path

MIN_CHARS, MIN_DOCS, FANOUT, BATCHES, HOT_KEYS = 40, 5, 2, 3, 1000
_KEY = ["h1", "h2"]
_LINE_SCHEMA = "doc_id long, tie long, pos int, first boolean, h1 long, h2 long, batch int"


class LineRuns:
    """Levelled runs in the shared folder; a context, on leaving which they are deleted."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}

    def __enter__(self) -> LineRuns:
        return self

    def __exit__(self, *_) -> None:
        self._drop(list(self.paths))

    def _write(self, rows: DataFrame) -> str:
        name = f"meridia_run_{uuid.uuid4().hex}"
        self.paths[name] = scratch_path(self.spark, "run")
        rows.write.bucketBy(self.buckets, *_KEY).sortBy(*_KEY).option("compression", "zstd").option("path", self.paths[name]).saveAsTable(name)
        return name

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            drop_scratch([self.paths.pop(name)], self.spark)

    def _runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def _merged(self, names: list[str]) -> str:
        """One run of several: two at a time are merged, bucket by bucket."""
        first, *others = names
        for other in others:
            a, b = self.spark.table(first), self.spark.table(other).withColumnsRenamed({"n_docs": "n", "last_doc": "last"})
            both = a.join(b.hint("merge"), _KEY, "full")
            total = F.coalesce("n_docs", F.lit(0)) + F.coalesce("n", F.lit(0))
            run = self._write(both.select(*_KEY, total.alias("n_docs"), F.greatest("last_doc", "last").alias("last_doc")))
            self._drop([first, other])
            first = run
        return first

    def new_lines(self, rows: DataFrame) -> DataFrame:
        """The rows whose key no run has yet: the merge-anti-join."""
        for name in self._runs():
            rows = rows.join(self.spark.table(name).select(*_KEY).hint("merge"), _KEY, "left_anti")
        return rows

    def add(self, lines: DataFrame) -> None:
        """Adds a batch: rows (doc_id, h1, h2) of documents below those of all batches before."""
        docs = lines.groupBy(*_KEY, "doc_id").agg(F.lit(1).alias("one"))  # rows that share a doc_id are one document
        batch = self._write(docs.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc")))
        if self._runs():
            own = self.spark.table(batch)
            new = self._write(self.new_lines(own))
            last = self.spark.table(new).select(*_KEY, "last_doc").hint("merge")
            run = self._write(own.drop("last_doc").join(last, _KEY, "left").select(*_KEY, "n_docs", "last_doc"))
            self._drop([batch, new])
            batch = run
        level = 0
        while True:
            if len(self.levels) == level:
                self.levels.append([])
            self.levels[level].append(batch)
            if len(full := self.levels[level]) < self.fanout:
                return
            self.levels[level] = []
            batch = self._merged(full)
            level += 1

    def rows(self) -> DataFrame:
        """Every key with its number of documents and the largest of them; all runs become one."""
        if not (names := self._runs()):
            return self.spark.createDataFrame([], "h1 long, h2 long, n_docs long, last_doc long")
        self.levels = [[] for _ in self.levels[:-1]] + [[self._merged(names)]]
        return self.spark.table(self.levels[-1][0])


def line_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, batches: int = BATCHES) -> DataFrame:
    """One row for each line that is long enough; ``first`` marks a key's first line in its row."""

    def run(parts):
        for batch in parts:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                doc, tie, no, pos, first, h1, h2 = [], [], [], [], [], [], []
                for d, t, b, text in zip(*(c.to_pylist() for c in part.columns)):
                    if not text:
                        continue
                    seen = set()
                    for i, line in enumerate(text.split("\n")):
                        if len(line) < min_chars:
                            continue
                        key = line.strip(WS)
                        if len(key) < min_chars:
                            continue
                        h = xxhash.xxh3_128_digest(key.encode().lower())
                        doc.append(d)
                        tie.append(t)
                        no.append(b)
                        pos.append(i)
                        first.append(h not in seen)
                        seen.add(h)
                        h1.append(int.from_bytes(h[:8], "little", signed=True))
                        h2.append(int.from_bytes(h[8:], "little", signed=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(tie, pa.int64()), pa.array(pos, pa.int32()), pa.array(first, pa.bool_()),
                     pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(no, pa.int32())],
                    ["doc_id", "tie", "pos", "first", "h1", "h2", "batch"],
                )

    doc_id, text = docs[id_col].cast("long"), docs[text_col]
    # Any limits give the same result; the last batch is that of the least doc_ids, and of none.
    limits = docs.agg(F.percentile_approx(doc_id, [1 - b / batches for b in range(1, batches)] or [0.0], 1000)).first()[0] or []
    batch_no = F.lit(batches - 1)
    for b, limit in reversed(list(enumerate(limits[: batches - 1]))):
        batch_no = F.when(doc_id >= limit, b).otherwise(batch_no)
    d = docs.select(doc_id.alias("doc_id"), F.xxhash64(text).alias("tie"), batch_no.alias("batch"), text.alias("text"))
    return d.mapInArrow(run, _LINE_SCHEMA)


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                  min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT, hot_keys: int = HOT_KEYS) -> DataFrame:
    """Rows (doc_id, tie, dropped): numbers of the lines that go. tie: hash of the text, as doc_ids may repeat."""
    with Scratch(docs.sparkSession) as scratch, LineRuns(docs.sparkSession, fanout) as runs:
        lines = scratch.keep(line_table(docs, id_col, text_col, min_chars, batches), "lines", ["batch"])
        for b in range(batches):
            runs.add(lines.filter((F.col("batch") == b) & F.col("first")).select("doc_id", *_KEY))
        frequent = scratch.keep(runs.rows().filter(F.col("n_docs") >= min_docs), "frequent")
        hot = scratch.keep(frequent.orderBy(F.desc("n_docs"), *_KEY).limit(hot_keys), "hot-keys")
        goes = ~F.col("doc_id").eqNullSafe(F.col("last_doc"))
        common = lines.join(F.broadcast(hot), _KEY).filter(goes).select("doc_id", "tie", "pos")  # hot_keys rows
        rest = frequent.join(F.broadcast(hot.select(*_KEY)), _KEY, "left_anti")
        rare = lines.join(F.broadcast(hot.select(*_KEY)), _KEY, "left_anti").join(rest, _KEY).filter(goes).select("doc_id", "tie", "pos")
        gone = common.unionByName(rare).groupBy("doc_id", "tie").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))
        return materialize(gone, "dropped")


def _with_kept(docs: DataFrame, id_col: str, text_col: str, dropped: DataFrame) -> DataFrame:
    """docs with __lines (before), __kept (after) and __n_dropped; the join is on id and text hash.

    What is kept are the stretches between the dropped positions, each copied once. Always a merge
    join: what is dropped grows with the input, so a broadcast that fits small inputs would only hide what
    the join costs on large ones."""
    dropped = dropped.hint("merge").select(F.col("doc_id").alias("__id"), F.col("tie").alias("__tie"), F.col("dropped").alias("__dropped"))
    joined = docs.join(dropped, docs[id_col].cast("long").eqNullSafe(dropped["__id"]) & F.xxhash64(docs[text_col]).eqNullSafe(dropped["__tie"]), "left")
    lines = F.split(F.coalesce(docs[text_col], F.lit("")), "\n", -1)
    before, after = F.concat(F.array(F.lit(-1)), "__dropped"), F.concat("__dropped", F.array(F.size("__lines")))
    stretches = F.zip_with(before, after, lambda a, b: F.slice("__lines", a + 2, b - a - 1))
    kept = F.when(F.col("__dropped").isNull(), F.col("__lines")).otherwise(F.flatten(stretches))
    return joined.withColumn("__lines", lines).withColumn("__kept", kept).withColumn("__n_dropped", F.coalesce(F.size("__dropped"), F.lit(0)))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """Rows (doc_id, n_lines, n_dropped, kept_sha256), one per document."""
    d = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    both = _with_kept(d, "doc_id", "text", dropped_lines(d, **limits))
    return both.select(
        d["doc_id"], F.size("__lines").cast("long").alias("n_lines"), F.col("__n_dropped").cast("long").alias("n_dropped"),
        F.sha2(F.array_join("__kept", "\n").cast("binary"), 256).alias("kept_sha256"),
    )


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """docs with the lines gone from their texts; null texts stay null."""
    both = _with_kept(docs, id_col, text_col, dropped_lines(docs, id_col, text_col, **limits))
    text = F.when(F.col("__n_dropped") > 0, F.array_join("__kept", "\n")).otherwise(docs[text_col])
    both = both.withColumn("__text", text)
    new = {text_col: F.col("__text"), "n_chars": F.length("__text").cast("long")}
    return both.select(*[new[c].alias(c) if c in new else docs[c] for c in docs.columns])
