"""Operator 10: SimHash near-dedup with a byte-position inverted index.

A 64-bit fingerprint has eight positional bytes. Fingerprints that differ in at most
two bits differ in at most two bytes, so they share at least SHARED = 6 positional bytes, and of
the four two-byte blocks at least two whole ones. A posting list of one byte would hold a
256th of all fingerprints; so the index's postings are joint ones, of every two blocks
(six lists for each fingerprint, 32 bits each). Fingerprints that meet in a posting are
counted: pairs that share at least SHARED positional bytes are kept and verified by their
differing bits.

Work is on distinct fingerprints, so copies never multiply pairs. Postings of at most
POSTING_CAP fingerprints make pairs. For longer ones the rest is exact without pairs: within a
posting only 32 bits are open, every fingerprint also files itself under its 32 one-bit
changes of them, and two of them meet under one such entry if and only if they differ
in at most two bits; an entry holds 33 at most, and a star to the least of them links them.
Components of the links come from large-star and small-star steps.

The pipeline's stage takes similarity 0.8 in five-word shingles: it has the links of this index, and those that
fingerprints can't tell from an exact join (see shingle_join).

Defined results: null text has no words; documents without words have fingerprint zero
and link like any other; component_id is the smallest doc_id, null ones aside; repeated
rows each get a result row. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, materialize
from .components import components

SEED, SHINGLE, MAX_BITS, SHARED, POSTING_CAP = 42, 3, 2, 6, 16
#: A fingerprint of more than this part of the rows is hot.
SUPPORT = 0.001
_CHUNK = 1 << 16


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """The signed 64-bit SimHash of a text."""
    w = (text or "").encode().lower().split()  # bytes: A-Z alone, and ASCII white space alone
    if not w:
        return 0
    if len(w) < words:
        shingles = [b" ".join(w)]
    elif words == 3:
        shingles = map(b"%b %b %b".__mod__, zip(w, w[1:], w[2:]))
    else:
        shingles = map(b" ".join, zip(*(w[i:] for i in range(words))))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, SEED) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(h), _CHUNK):
        bits = np.unpackbits(h[lo : lo + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE) -> DataFrame:
    """Rows (doc_id, fp)."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                fp = [fingerprint(t, words) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, fp long")


def _block(no: int) -> Column:
    return F.shiftrightunsigned("fp", 16 * no).bitwiseAND(0xFFFF)


_PAIRS = [(a, b) for a in range(4) for b in range(a + 1, 4)]


def postings(fps: DataFrame) -> DataFrame:
    """Rows (list_no, bytes, rest, fp): six for each fingerprint; rest: the bits that the posting leaves open."""
    of = []
    for no, (a, b) in enumerate(_PAIRS):
        c, d = (x for x in range(4) if x not in (a, b))
        of.append(F.struct(
            F.lit(no).alias("list_no"), (_block(a) * 65536 + _block(b)).alias("bytes"), (_block(c) * 65536 + _block(d)).alias("rest"),
        ))
    return fps.select("fp", F.explode(F.array(*of)).alias("p")).select("p.*", "fp")


def shared_bytes(a: Column, b: Column) -> Column:
    """The tally: at how many of the eight positions the bytes agree."""
    x = a.bitwiseXOR(b)
    return sum((F.when(F.shiftrightunsigned(x, 8 * i).bitwiseAND(255) == 0, 1).otherwise(0) for i in range(8)), F.lit(0))


def links(fps: DataFrame, scratch: Scratch, max_bits: int = MAX_BITS, cap: int = POSTING_CAP) -> DataFrame:
    """Rows (u, v): links whose components are those of all pairs within ``max_bits`` (2 at most).

    fps: distinct fp."""
    if max_bits > 2:
        raise ValueError("two whole blocks are only guaranteed for up to two differing bits")
    index = scratch.keep(postings(fps), "postings")
    key = ["list_no", "bytes"]
    sizes = index.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v"))
    sizes = scratch.keep(sizes.filter("n > 1"), "posting-sizes")
    couples = sizes.filter("n = 2").select("u", "v")
    some = index.join(sizes.filter(f"n > 2 AND n <= {cap}").select(*key), key)
    listed = some.groupBy(*key).agg(F.sort_array(F.collect_list("fp")).alias("l"))  # cap entries at most
    some = listed.select(F.posexplode("l").alias("i", "u"), "l").select("u", F.explode(F.slice("l", F.col("i") + 2, cap)).alias("v"))
    pairs = couples.unionByName(some)
    pairs = pairs.filter(shared_bytes(F.col("u"), F.col("v")) >= SHARED)
    verified = pairs.filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits)
    hot = index.join(sizes.filter(f"n > {cap}").select(*key), key)
    if max_bits == 2:
        changes = [F.lit(0).cast("long"), *[F.lit(1 << b).cast("long") for b in range(32)]]
        filed = hot.select(*key, "fp", F.explode(F.transform(F.array(*changes), lambda m: F.col("rest").bitwiseXOR(m))).alias("entry"))
    else:  # at most one bit: file under every pattern with that bit taken out
        holes = [F.struct(F.lit(b).alias("b"), F.lit(~(1 << b) & 0xFFFFFFFF).cast("long").alias("mask")) for b in range(32)]
        filed = hot.select(*key, "fp", F.explode(F.transform(F.array(*holes), lambda h: F.struct(h["b"].alias("b"), F.col("rest").bitwiseAND(h["mask"]).alias("r")))).alias("entry"))
    entries = filed.groupBy(*key, "entry").agg(F.collect_list("fp").alias("l")).filter(F.size("l") > 1)
    stars = entries.select(F.array_min("l").alias("v"), F.explode("l").alias("u")).filter("u <> v").select("u", "v")
    return verified.unionByName(stars).distinct()


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, max_bits: int = MAX_BITS, support: float = SUPPORT) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id), one per document.

    Fingerprints of more than ``support`` of the rows, 1 / support at most, get their component by a broadcast, so
    that no group of copies meets in one task."""
    with Scratch(docs.sparkSession) as scratch:
        rows = materialize(fingerprints(docs, id_col, text_col, words), "fingerprints")
        fps = scratch.keep(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct-fps")
        label = materialize(_component_ids(fps, links(fps.select("fp"), scratch, max_bits), scratch), "labels")
        n = fps.agg(F.sum("n")).first()[0] or 0
    hot = label.filter(F.col("n") > max(1, int(n * support))).drop("n")
    often = rows.join(F.broadcast(hot), "fp")
    rest = rows.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(label.drop("n"), "fp")
    return often.unionByName(rest).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _component_ids(fps: DataFrame, linked: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (fp, n, component_id): the least doc_id of all that the links (u, v) join. fps: fp, least, n."""
    roots = components(linked)
    rooted = scratch.keep(fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")), "rooted")
    # Only components of several fingerprints need the least doc_id of all of them.
    several = roots.select("root").distinct()
    least = scratch.keep(rooted.join(several, "root", "left_semi").groupBy("root").agg(F.min("least").alias("component_id")), "least-ids")
    return rooted.join(least, "root", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id"))
