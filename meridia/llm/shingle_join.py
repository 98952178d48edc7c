"""The pipeline's near dedup: groups of texts of similarity 0.8 in five-word shingles, found exactly.

SimHash fingerprints of the texts' five-word shingles meet in the positional-byte index of operator 10; pairs that
pass its count filter and differ in at most two bits are candidates, checked on their whole shingle sets. Fingerprints
can't tell texts at that similarity apart, so an exact join of shingle sets gives the pairs that they miss. Sets are
of 64-bit hashes; equal texts are one entry, whose id is a 64-bit hash of the text (a second hash
keeps rows of other texts apart, if ever two share an id).

1. A sketch counts all shingles of the corpus in SKETCH_SLOTS counters. It is of fixed size, whatever the input, and
   only orders shingles: a shingle's count is at most its slot's, so those of small slots are rare. Any common
   order gives the same result; the fuller the slots, the more candidates.
2. Two sets of the similarity share that part of each at least, so in a common order the first n - least + 1
   shingles of each, its prefix, hold a common one. Prefixes are dealt by shingle and sorted: one streaming
   pass pairs every entry of a posting with the posting's first, and writes the postings of several entries.
3. Those pairs, and the candidates of the fingerprints, are counted on the whole sets; components of what is similar settle most postings. In the others,
   of at most POSTING_CAP entries, all pairs of different components are counted. Longer ones meet a second
   hub, and what is left is compared block by block, so no posting makes all its pairs.

Work grows with the number of shingles; nothing is capped or left out. Texts are hashed again in each step rather
than kept as arrays, which are larger than the texts.

Defined results: null text has no words; texts without words are one group; texts of fewer than five words have one
shingle, of all their words; component_id is the smallest doc_id, null ones aside; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import Scratch, materialize, row_key
from .components import components

SEED, WIDE_SHINGLE, SIMILARITY = 42, 5, 0.8
#: Entries of a posting that makes all its pairs, and entries of a block.
POSTING_CAP, BLOCK = 16, 256
#: Counters of the sketch (a byte each when sent), and counters in one of its parts.
SKETCH_SLOTS, PART = 1 << 22, 1 << 16
#: Shuffle partitions from twice which on the parts are summed in two levels.
LEVEL = 256
_SLICE = 256
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


#: Lower-case bytes with one kind of white space, and a number for each byte.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32
_NUMBERS = np.array([xxhash.xxh64_intdigest(bytes([i]), SEED) for i in range(256)], np.uint64)
_BASE = 0xD6E8FEB86659FD93
#: Powers of the base and of its inverse; grown as needed, and kept up to a bound.
_powers = {n: np.ones(1, np.uint64) for n in (_BASE, pow(_BASE, -1, 1 << 64))}


def _powers_of(base: int, n: int) -> np.ndarray:
    known = _powers[base]
    while len(known) < n:
        known = np.concatenate([known, known * np.uint64(pow(base, len(known), 1 << 64))])
        if len(known) <= 1 << 22:
            _powers[base] = known
    return known[:n]


def shingle_keys(text: str | None, words: int = WIDE_SHINGLE, piece: int = 1 << 18) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted. ASCII case and white space alone are folded.

    Of the folded bytes running sums are taken, each byte's number times a power of the base by its place; a
    shingle's hash is the difference of two sums, moved to place 0, and mixed. Texts go by pieces of shingles."""
    b = _FOLD[np.frombuffer((text or "").encode(), np.uint8)]
    space = b == 32
    keep = ~space
    keep[1:] |= ~space[:-1]  # the first of a run of white space stays
    b = b[keep]
    if len(b) and b[0] == 32:
        b = b[1:]
    if len(b) and b[-1] == 32:
        b = b[:-1]
    if not len(b):
        return np.zeros(0, np.int64)
    spaces = np.flatnonzero(b == 32)
    starts, ends = np.concatenate([[0], spaces + 1]), np.concatenate([spaces, [len(b)]])
    used = min(words, len(starts))
    starts, ends = starts[: len(starts) - used + 1], ends[used - 1 :]
    found = []
    for lo in range(0, len(starts), piece):
        s, e = starts[lo : lo + piece], ends[lo : lo + piece]
        at = s[0]
        n = int(e[-1] - at)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_NUMBERS[b[at : at + n]] * _powers_of(_BASE, n), out=sums[1:])
        key = (sums[e - at] - sums[s - at]) * _powers_of(pow(_BASE, -1, 1 << 64), n)[s - at]
        key ^= key >> np.uint64(32)
        key *= _MULTIPLIER
        found.append(key ^ (key >> np.uint64(29)))
    return np.unique((found[0] if len(found) == 1 else np.concatenate(found)).view(np.int64))


def _slots(keys: np.ndarray) -> np.ndarray:
    return (keys.view(np.uint64) * _MULTIPLIER >> np.uint64(64 - (SKETCH_SLOTS - 1).bit_length())).astype(np.int64)


def _sets(batches, wanted: np.ndarray | None = None):
    """(id, keys) of the texts of a task, each entry once; only those that the sketch ``wanted`` passes."""
    seen = set()
    for batch in batches:
        for lo in range(0, batch.num_rows, _SLICE):
            part = batch.slice(lo, _SLICE)
            if wanted is not None:
                part = part.filter(pa.array(wanted[_slots(part.column(0).to_numpy())] > 0))
            found = []
            for entry, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if entry not in seen:
                    seen.add(entry)
                    if len(keys := shingle_keys(text)):
                        found.append((entry, keys))
            if found:
                yield found


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, pa.int64()))


def sketch(rows: DataFrame, arrays) -> np.ndarray:
    """Counters of hashed numbers, one byte each, on a logarithmic scale. arrays: from a task's batches to arrays of numbers.

    Each task sends its counters in compressed parts; sums are taken part by part, in two levels on wide clusters. To
    the driver comes the sketch alone."""
    width = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // LEVEL)

    def sent(total: dict[int, np.ndarray], scale=False):
        from pyspark import TaskContext

        salt = TaskContext.get().partitionId() % width
        for no, some in total.items():
            some = np.round(np.log2(some + 1.0) * 7).astype(np.uint8) if scale else some.astype("<u4")
            yield pa.RecordBatch.from_arrays([pa.array([no], pa.int32()), pa.array([salt], pa.int32()), pa.array([zlib.compress(some.tobytes(), 1)])], ["part", "salt", "counts"])

    def put(total: dict[int, np.ndarray], no: int, counts: np.ndarray) -> None:
        if no in total:
            total[no] += counts
        else:
            total[no] = counts.astype(np.int64)

    def file(total: dict[int, np.ndarray], waiting: list[np.ndarray]) -> None:
        slots = np.sort(_slots(np.concatenate(waiting)))
        stops = np.searchsorted(slots, np.arange(PART, SKETCH_SLOTS + 1, PART))
        for no in np.flatnonzero(np.diff(stops, prepend=0)):
            put(total, int(no), np.bincount(slots[stops[no - 1] if no else 0 : stops[no]] - no * PART, minlength=PART))

    def count(batches):
        total: dict[int, np.ndarray] = {}
        waiting, size = [], 0
        for keys in arrays(batches):
            waiting.append(keys)
            size += len(keys)
            if size > 1 << 20:
                file(total, waiting)
                waiting, size = [], 0
        if waiting:
            file(total, waiting)
        yield from sent(total)

    def add(batches, scale):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for no, counts in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                put(total, no, np.frombuffer(zlib.decompress(counts), "<u4"))
        yield from sent(total, scale)

    schema = "part int, salt int, counts binary"
    summed = rows.mapInArrow(count, schema)
    if width > 1:
        summed = summed.repartition("part", "salt").mapInArrow(lambda b: add(b, False), schema)
    out = np.zeros(SKETCH_SLOTS, np.uint8)
    for no, _, counts in summed.repartition("part").mapInArrow(lambda b: add(b, True), schema).collect():
        out[no * PART : (no + 1) * PART] = np.frombuffer(zlib.decompress(counts), np.uint8)
    return out


def _alike(both, m, n, similarity: float):
    """Whether sets of m and n keys, ``both`` of them common, are that similar."""
    return both * (1 + similarity) >= (m + n) * similarity - 1e-9


def prefixes(texts: DataFrame, order, similarity: float) -> DataFrame:
    """Rows (k, id, n, i): the first keys of each entry, n all its keys, i from 1. order: the sketch, broadcast."""

    def run(batches):
        by = order.value
        for found in _sets(batches):
            k, ids, ns, at = [], [], [], []
            for entry, keys in found:
                n = len(keys)
                slots = n - int(np.ceil(similarity * n - 1e-9)) + 1
                k.append(keys[np.argsort(by[_slots(keys)], kind="stable")[:slots]])
                ids.append(np.full(slots, entry, np.int64))
                ns.append(np.full(slots, n, np.int32))
                at.append(np.arange(1, slots + 1, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (k, ids, ns, at)], ["k", "id", "n", "i"])

    return texts.select("id", "text").mapInArrow(run, "k long, id long, n int, i int")


def postings(index: DataFrame) -> DataFrame:
    """Rows (k, id, n, i, hub, hub_n, hub_i) of the postings of several entries; hub: the first entry of the posting.

    A stream over sorted rows: of a posting only its first row is held."""
    wide = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        last = None  # the row before, and whether it has gone out already
        hub, out_already = None, False
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(4)])
            if last is not None:
                rows = np.concatenate([last[:, None], rows], axis=1)
            same_key = rows[0, 1:] == rows[0, :-1]
            fresh = np.concatenate([[True], ~(same_key & (rows[1, 1:] == rows[1, :-1]))])
            rows = rows[:, fresh]
            if not rows.shape[1]:
                continue
            starts = np.concatenate([[True], rows[0, 1:] != rows[0, :-1]])
            group = np.cumsum(starts) - 1
            heads = rows[:, starts].copy()
            if last is not None:
                heads[:, 0] = hub
            sizes = np.bincount(group)
            several = sizes[group] > 1
            if last is not None and out_already:
                several[group == 0] = True
                several[0] = False
            last, hub = rows[:, -1].copy(), heads[:, -1].copy()
            out_already = bool(several[-1]) or (rows.shape[1] == 1 and out_already)
            send = rows[:, several]
            head = heads[:, group[several]]
            if send.shape[1]:
                cols = [send[0], send[1], send[2].astype(np.int32), send[3].astype(np.int32), head[1], head[2].astype(np.int32), head[3].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["k", "id", "n", "i", "hub", "hub_n", "hub_i"])

    dealt = index.repartition(wide, "k").sortWithinPartitions("k", "id")
    return dealt.mapInArrow(run, "k long, id long, n int, i int, hub long, hub_n int, hub_i int")


def _possible(i: Column, n: Column, j: Column, m: Column, similarity: float) -> Column:
    """Whether sets of n and m keys can be similar that have a common key as their i-th and j-th."""
    return _alike(F.least(i, j) + F.least(n - i, m - j), n, m, similarity)


def whole_sets(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows (id, n, s): the whole sets of the entries ``ids``. A sketch of them passes few others; the join is exact."""
    wanted = ids.sparkSession.sparkContext.broadcast(sketch(ids, lambda batches: (b.column(0).to_numpy() for b in batches)))

    def run(batches):
        for found in _sets(batches, wanted.value):
            sizes = np.array([len(k) for _, k in found])
            lists = _lists(np.concatenate([k for _, k in found]), sizes)
            yield pa.RecordBatch.from_arrays([pa.array([e for e, _ in found], pa.int64()), pa.array(sizes, pa.int32()), lists], ["id", "n", "s"])

    return texts.select("id", "text").mapInArrow(run, "id long, n int, s array<long>").dropDuplicates(["id"]).join(ids, "id", "left_semi")


def similar_pairs(pairs: DataFrame, entries: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sets are that similar; counted, not estimated."""
    a, b = (entries.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("s").alias(f"s{x}")) for x in "uv")
    near = pairs.join(a, "u").join(b, "v")

    def run(batches):
        for batch in batches:
            batch = pa.Table.from_batches([batch]).combine_chunks()
            u, v, n, m = (batch[c].to_numpy() for c in ("u", "v", "nu", "nv"))
            keep = np.zeros(len(u), bool)
            x, y = batch["su"].combine_chunks(), batch["sv"].combine_chunks()
            (xo, xs), (yo, ys) = ((z.offsets.to_numpy() - z.offsets[0].as_py(), z.flatten().to_numpy()) for z in (x, y))
            for r in range(len(u)):
                p, q = xs[xo[r] : xo[r + 1]], ys[yo[r] : yo[r + 1]]
                at = np.minimum(np.searchsorted(p, q), len(p) - 1)
                keep[r] = _alike(int((p[at] == q).sum()), int(n[r]), int(m[r]), similarity)
            yield pa.RecordBatch.from_arrays([pa.array(u[keep]), pa.array(v[keep])], ["u", "v"])

    return near.select("u", "v", "nu", "nv", "su", "sv").mapInArrow(run, "u long, v long")


def fingerprint_pairs(texts: DataFrame, scratch: Scratch, words: int = WIDE_SHINGLE) -> DataFrame:
    """Rows (u, v) of entries whose fingerprints agree or are linked by operator 10's index, a star for each fingerprint.

    Candidates: whether the sets are similar is counted after."""
    fps = scratch.keep(simhash.fingerprints(texts, "id", "text", words).select(F.col("doc_id").alias("id"), "fp").distinct(), "entry-fingerprints")
    least = scratch.keep(fps.groupBy("fp").agg(F.min("id").alias("least")), "least-entries")
    linked = simhash.links(least.select("fp"), scratch)
    same = fps.join(least, "fp").filter("id <> least").select(F.col("least").alias("u"), F.col("id").alias("v"))
    a, b = (least.select(F.col("fp").alias(x), F.col("least").alias(f"l{x}")) for x in "uv")
    near = linked.join(a, "u").join(b, "v").select(F.least("lu", "lv").alias("u"), F.greatest("lu", "lv").alias("v"))
    return scratch.keep(same.unionByName(near), "fingerprint-pairs")


def _rooted(rows: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """rows of the postings (k, id, ...) with ``root``, without those postings that the links have joined."""
    roots = components(links)
    rooted = rows.join(roots, rows["id"] == roots["node"], "left").select(*rows.columns, F.coalesce("root", "id").alias("root"))
    rooted = scratch.keep(rooted, "rooted")
    mixed = rooted.groupBy("k").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count(F.lit(1)).alias("c")).filter("a < b").select("k", "c")
    return scratch.keep(rooted.join(mixed, "k"), "mixed")


def block_links(mixed: DataFrame, entries: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """Rows (u, v): of the similar pairs in a posting whose ends have different roots, one at least for every two roots.

    Entries of a posting's most frequent root are joined already. All others are dealt into blocks, and every
    such block meets every block of all its entries."""

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side = table["side"].to_numpy()
        lists = table["s"].combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        _, column = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        row = np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        both = np.zeros((len(left), len(right)), np.float32)
        for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            x, y = np.searchsorted(column, [lo, lo + 4096])
            has = np.zeros((len(sizes), 4096), np.float32)
            has[row[x:y], column[x:y] - lo] = 1
            both += has[left] @ has[right].T
        n, root, ids = table["n"].to_numpy().astype(np.int64), table["root"].to_numpy(), table["id"].to_numpy()
        alike = _alike(both.astype(np.float64), n[left][:, None], n[right][None, :], similarity)
        i, j = np.nonzero(alike & (root[left][:, None] != root[right][None, :]))
        i, j = left[i], right[j]
        _, first = np.unique(np.stack([root[i], root[j]], axis=1), axis=0, return_index=True)
        u, v = ids[i[first]], ids[j[first]]
        return pa.table({"u": np.minimum(u, v), "v": np.maximum(u, v)})

    counts = mixed.groupBy("k", "root").agg(F.count(F.lit(1)).alias("c"))
    most = counts.groupBy("k").agg(F.max_by("root", F.struct("c", "root")).alias("most"), F.sum("c").alias("all"), (F.sum("c") - F.max("c")).alias("rest"))
    d = mixed.select("k", "id", "root").join(most, "k").select("k", "id", "root", "most", *[F.ceil(F.col(c) / block).cast("int").alias(f"n_{c}") for c in ("rest", "all")])
    mine = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    left = d.filter("root <> most").select("k", "id", "root", F.lit(0).alias("side"), mine("n_rest").alias("a"), F.explode(every("n_all")).alias("b"))
    right = d.select("k", "id", "root", F.lit(1).alias("side"), mine("n_all").alias("b"), F.explode(every("n_rest")).alias("a"))
    dealt = left.unionByName(right).join(entries.select("id", "n", "s"), "id")
    return dealt.groupBy("k", "a", "b").applyInArrow(compare, "u long, v long").distinct()


def similar_links(texts: DataFrame, scratch: Scratch, similarity: float = SIMILARITY, cap: int = POSTING_CAP, block: int = BLOCK) -> DataFrame:
    """Rows (u, v) of entries: links whose components are those of all similar pairs. texts: (id, text)."""
    sc = texts.sparkSession.sparkContext
    order = sc.broadcast(sketch(texts.select("id", "text"), lambda batches: (keys for found in _sets(batches) for _, keys in found)))
    met = scratch.keep(postings(prefixes(texts, order, similarity)), "postings")
    first = met.filter("id <> hub").filter(_possible(F.col("i"), F.col("n"), F.col("hub_i"), F.col("hub_n"), similarity))
    first = first.select(F.least("id", "hub").alias("u"), F.greatest("id", "hub").alias("v"))
    first = scratch.keep(first.unionByName(fingerprint_pairs(texts, scratch)).distinct(), "first-pairs")
    links = scratch.keep(similar_pairs(first, whole_sets(texts, _ends(first).distinct()), similarity), "links")
    mixed = _rooted(met.select("k", "id", "n", "i"), links, scratch)
    listed = mixed.filter(f"c <= {cap}").groupBy("k").agg(F.sort_array(F.collect_list(F.struct("id", "n", "i", "root"))).alias("l"))  # cap entries at most
    pairs = listed.select(F.posexplode("l").alias("at", "a"), "l").select("a", F.explode(F.slice("l", F.col("at") + 2, cap)).alias("b"))
    a, b = F.col("a"), F.col("b")
    pairs = pairs.filter((a["root"] != b["root"]) & _possible(a["i"], a["n"], b["i"], b["n"], similarity)).select(a["id"].alias("u"), b["id"].alias("v"))
    long = scratch.keep(mixed.filter(f"c > {cap}").select("k", "id", "root"), "long")
    # A second hub in every longer posting, another one in each.
    hubs = long.groupBy("k").agg(F.min_by(F.struct("id", "root"), F.xxhash64("k", "id")).alias("hub"))
    hubs = long.join(hubs, "k").filter(F.col("root") != F.col("hub.root")).select(F.least("id", "hub.id").alias("u"), F.greatest("id", "hub.id").alias("v"))
    pairs = scratch.keep(pairs.unionByName(hubs).distinct().join(first, ["u", "v"], "left_anti"), "pairs")
    entries = scratch.keep(whole_sets(texts, _ends(pairs).unionByName(long.select("id")).distinct()), "entries")
    links = scratch.keep(links.unionByName(similar_pairs(pairs, entries, similarity)), "links")
    if long.isEmpty():
        return links
    return links.unionByName(scratch.keep(block_links(_rooted(long.select("k", "id"), links, scratch), entries, similarity, block), "block-links"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("u").alias("id")).unionByName(pairs.select(F.col("v").alias("id")))


def entry_ids(text: Column) -> tuple[Column, Column]:
    """The id of a text's entry and a second hash. Texts without words are one entry."""
    text = F.when(F.rlike(text, F.lit(r"[^\x20\x09-\x0D]")), text)
    return F.xxhash64(text), F.xxhash64(F.lit(7), text)


def _groups(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, id, e2), one per document, and rows (id, e2, least, root, own): each entry's first row and its group."""
    text = docs[text_col]
    (h1, h2), (entry, e2) = row_key(docs[id_col], text), entry_ids(text)
    rows = docs.select(h1.alias("h1"), h2.alias("h2"), docs[id_col].cast("long").alias("doc_id"), entry.alias("id"), e2.alias("e2"))
    rows = scratch.keep(rows, "rows")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h1", "h2")).alias("least")
    entries = scratch.keep(rows.groupBy("id", "e2").agg(least), "row-entries")
    roots = components(similar_links(docs.select(entry.alias("id"), text.alias("text")), scratch, similarity))
    rooted = entries.join(roots, entries["id"] == roots["node"], "left").select("id", "e2", "least", F.coalesce("root", "id").alias("root"))
    # Of entries that share an id, were there any, all but one stay apart.
    first = F.row_number().over(Window.partitionBy("id").orderBy("e2"))
    rooted = rooted.withColumn("own", F.when(first > 1, F.col("e2")))
    return rows, scratch.keep(rooted, "groups")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Rows (doc_id, component_id): groups of texts that share ``similarity`` of their five-word shingles or more."""
    with Scratch(docs.sparkSession) as scratch:
        rows, groups = _groups(docs, scratch, id_col, text_col, similarity)
        ids = groups.groupBy("root", "own").agg(F.min("least").alias("w"))
        label = groups.join(ids, groups["root"].eqNullSafe(ids["root"]) & groups["own"].eqNullSafe(ids["own"])).select("id", "e2", F.col("w.doc_id").alias("component_id"))
        return materialize(rows.join(label, ["id", "e2"]).select("doc_id", "component_id"), "similar-groups")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each group of similar texts: the one with the smallest doc_id, null last.

    Rows that share the smallest doc_id and differ in text: the one of the smallest hash stays. Rows that agree in
    both are one."""
    with Scratch(docs.sparkSession) as scratch:
        _, groups = _groups(docs, scratch, id_col, text_col, similarity)
        keep = groups.groupBy("root", "own").agg(F.min("least").alias("w")).select(F.col("w.h1").alias("__h1"), F.col("w.h2").alias("__h2"))
        keep = materialize(keep, "kept-rows")
    h1, h2 = row_key(docs[id_col], docs[text_col])
    # Always a merge join: the kept rows grow with the input.
    kept = docs.withColumns({"__h1": h1, "__h2": h2}).join(keep.hint("merge"), ["__h1", "__h2"], "left_semi")
    return kept.dropDuplicates(["__h1", "__h2"]).drop("__h1", "__h2")
