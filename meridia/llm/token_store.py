"""Operator 3: token-id output in a binary block format with Elias-Fano boundaries.

The store is a Parquet table written by Spark's own committer (so it lands in any
file system that Spark reaches, and a lost executor leaves no half-written file).
Each row is a block of whole documents in ascending doc_id order:

    shard, block   place in the order; shards are ranges of doc_id
    base           ids of the shard before this block
    n_docs, n_ids  size of the block
    n_null, first  documents without doc_id, which come first, and the first doc_id of the others
    doc_*          Elias-Fano code of the other doc_ids, less the first
    width, ids     the concatenated token ids, little-endian unsigned, 2 or 4 bytes each
    end_*          Elias-Fano code of the documents' end offsets in `ids`

Elias-Fano: of each end offset the lower `low_bits` bits are packed in `low`; the
upper parts are a unary bit string in `high` (bit `upper + i` set for offset i), about
2 + log2(n_ids / n_docs) bits a document in all. `samples` holds the bit place of each
SAMPLE-th one, so that select reads one sample and then scans a short way. Reading a store selects
each document's end; no table of 64-bit offsets or ids is kept.

Strings of special tokens in a text give the special token's id, as the tokenizers library does by default;
``ordinary=True`` makes them ordinary text.

Defined results: null text is an empty document, so only its end id; null doc_ids
come first; equal doc_ids are ordered by a hash of their texts; an empty table gives a
store without blocks. Other columns of the input are ignored.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch_path

SAMPLE = 256
#: A block is closed when it holds this many ids.
BLOCK_IDS = 1 << 20
#: Entries of the worker's cache of encoded chunks, and the longest chunk that it keeps.
CACHE_ENTRIES, CACHE_CHARS = 700_000, 64
BLOCK_SCHEMA = (
    "shard int, block int, base long, n_docs int, n_ids long, n_null int, first long, width int, ids binary, "
    "doc_low_bits int, doc_low binary, doc_high binary, doc_samples binary, end_low_bits int, end_low binary, end_high binary, end_samples binary"
)


class EliasFano:
    """A non-decreasing sequence of n offsets below ``universe + 1``."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.low_bits = n, low_bits
        self._low = np.frombuffer(low, np.uint8)
        self._high = np.frombuffer(high, np.uint8)
        self._samples = np.frombuffer(samples, "<u4")

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        if n == 0:
            return cls(0, 0, b"", b"", b"")
        values = values.astype(np.uint64)
        low_bits = max(0, (int(values[-1]) // n).bit_length() - 1)
        upper = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(upper[-1]) + 1, np.uint8)
        bits[upper] = 1
        low = b""
        if low_bits:
            shifts = np.arange(low_bits, dtype=np.uint64)
            low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little").tobytes()
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little").tobytes(), upper[::SAMPLE].astype("<u4").tobytes())

    def parts(self) -> tuple[int, bytes, bytes, bytes]:
        return self.low_bits, self._low.tobytes(), self._high.tobytes(), self._samples.tobytes()

    def _lower(self, i: int) -> int:
        at = i * self.low_bits
        whole = int.from_bytes(self._low[at // 8 : (at + self.low_bits + 7) // 8].tobytes(), "little")
        return (whole >> (at % 8)) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """Offset i, from one sample and a scan of its stretch of the bit string."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        start = int(self._samples[i // SAMPLE])
        stop = int(self._samples[i // SAMPLE + 1]) if i // SAMPLE + 1 < len(self._samples) else len(self._high) * 8 - 1
        bits = np.unpackbits(self._high[start // 8 : stop // 8 + 1], bitorder="little")
        bits[: start % 8] = 0
        place = start // 8 * 8 + int(np.flatnonzero(bits)[i % SAMPLE])
        return ((place - i) << self.low_bits) | (self._lower(i) if self.low_bits else 0)

    def all(self) -> np.ndarray:
        """All offsets at once."""
        upper = (np.flatnonzero(np.unpackbits(self._high, bitorder="little"))[: self.n] - np.arange(self.n)).astype(np.uint64)
        if not self.low_bits:
            return upper
        bits = np.unpackbits(self._low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        return (upper << np.uint64(self.low_bits)) + (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


#: White space other than space and line feed.
_OTHER_SPACE = [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"]
_PAIRS = ("  ", " \n", "\n ", "\n\n")
_SAFE = re.compile(r"(?<=\S)(?= )")
_STOP = re.compile(r"(?<=[^\W_])([.,])")
#: The printable character that stands for each byte in a byte-level vocabulary.
_BYTES = {b: chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174 else None for b in range(256)}
_BYTES |= {b: chr(256 + i) for i, b in enumerate(b for b, c in _BYTES.items() if c is None)}


class ChunkEncoder:
    """Encodes texts chunk by chunk, with a bounded cache of encoded chunks.

    Chunks end before a space that follows a character other than white space, on both
    sides of a line feed between two such characters, and before a full stop or comma that
    follows a letter or digit: the pre-splitting pattern of byte-level BPE always has a boundary
    there, so the chunks' ids, end to end, are those of the whole text. Words repeat far more
    often than they are new; a new one that is a single match of the pattern goes to the
    library's merges straight away, without the steps around them."""

    def __init__(self, tokenizer_file: str, ordinary: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.encode_special_tokens = ordinary
        added = {} if ordinary else {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.special = {c: np.array([i], self.dtype).tobytes() for c, i in added.items()}
        self.cache: dict[str, bytes] = dict(self.special)

    def _encode(self, chunks: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(chunks)
        mixed = []
        merges = self.tokenizer.model.tokenize
        for i, c in enumerate(chunks):
            if c.isalpha() or c[:1] == " " and c[1:].isalpha():
                symbols = c.encode().decode("latin-1").translate(_BYTES)
                out[i] = struct.pack(f"<{self.code * len(ids)}", *ids) if (ids := [x.id for x in merges(symbols)]) else b""
            else:
                mixed.append(i)
        if mixed:
            for i, x in zip(mixed, self.tokenizer.encode_batch_fast([chunks[i] for i in mixed], add_special_tokens=False)):
                out[i] = np.array(x.ids, self.dtype).tobytes()
        return out

    def split(self, text: str) -> list[str]:
        """Chunks of the text; special tokens, where they count as such, are chunks of their own."""
        if self.added is None or not self.added.search(text):
            return self.chunks(text)
        return [c for at, part in enumerate(self.added.split(text)) for c in ([part] if at % 2 else self.chunks(part))]

    @staticmethod
    def chunks(text: str) -> list[str]:
        if not text:
            return []
        holds = text.__contains__
        if holds("\x00") or text[0] in " \n" or text[-1] in " \n" or any(map(holds, _PAIRS)) or any(map(holds, _OTHER_SPACE)):
            return _SAFE.split(text)
        return _STOP.sub("\x00\\1", text).replace(" ", "\x00 ").replace("\n", "\x00\n\x00").split("\x00")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        cut = [self.split(t or "") for t in texts]
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
            self.cache.update(self.special)
        known = self.cache
        new = list({c for one in cut for c in one if c not in known})
        own: dict[str, bytes] = {}
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            for c, ids in zip(part, self._encode(part)):
                (known if len(c) <= CACHE_CHARS else own)[c] = ids
        if own:
            return [b"".join([own[c] if c in own else known[c] for c in one]) for one in cut]
        get = known.__getitem__
        return [b"".join(map(get, one)) for one in cut]


@functools.lru_cache(maxsize=2)
def _encoder(tokenizer_file: str, ordinary: bool) -> ChunkEncoder:
    """One for each worker process."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return ChunkEncoder(tokenizer_file, ordinary)


def _code(name: str, code: EliasFano) -> dict[str, pa.Array]:
    low_bits, *parts = code.parts()
    named = {f"{name}_{part}": pa.array([x], pa.binary()) for part, x in zip(("low", "high", "samples"), parts)}
    return {f"{name}_low_bits": pa.array([low_bits], pa.int32()), **named}


def _block(shard: int, block: int, base: int, doc_ids: list, parts: list[bytes], width: int) -> pa.RecordBatch:
    ends = np.cumsum([len(p) // width for p in parts], dtype=np.int64)
    known = [i for i in doc_ids if i is not None]
    first = known[0] if known else 0
    row = {
        "shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int32()), "base": pa.array([base], pa.int64()),
        "n_docs": pa.array([len(parts)], pa.int32()), "n_ids": pa.array([int(ends[-1])], pa.int64()),
        "n_null": pa.array([len(doc_ids) - len(known)], pa.int32()), "first": pa.array([first], pa.int64()),
        "width": pa.array([width], pa.int32()), "ids": pa.array([b"".join(parts)], pa.binary()),
        **_code("doc", EliasFano.build(np.array([i - first for i in known], np.uint64))), **_code("end", EliasFano.build(ends)),
    }
    return pa.RecordBatch.from_arrays(list(row.values()), list(row))


def write_store(docs: DataFrame, path: str, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text",
                end_id: int = 0, block_ids: int = BLOCK_IDS, ordinary: bool = False) -> None:
    """Writes the tokens of all documents in ascending doc_id order as a store at ``path``.

    One range shuffle of the texts; tokenising comes after it, once."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        from pyspark import TaskContext

        encoder = _encoder(tokenizer_file, ordinary)
        width, end = encoder.dtype.itemsize, np.array([end_id], encoder.dtype).tobytes()
        shard, block, base, size = TaskContext.get().partitionId(), 0, 0, 0
        doc_ids: list = []
        parts: list[bytes] = []
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist())):
                    doc_ids.append(doc_id)
                    parts.append(ids + end)
                    size += len(ids) // width + 1
                    if size >= block_ids:
                        yield _block(shard, block, base, doc_ids, parts, width)
                        block, base, size, doc_ids, parts = block + 1, base + size, 0, [], []
        if parts:
            yield _block(shard, block, base, doc_ids, parts, width)

    ordered = (
        docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("tie"))
        .repartitionByRange(n, "doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
    )
    # Ids hardly shrink further when compressed by a general method; lz4 costs next to nothing.
    ordered.mapInArrow(run, BLOCK_SCHEMA).write.option("compression", "lz4_raw").parquet(path)


def read_store(spark, path: str) -> DataFrame:
    """Blocks with ``start``: ids of all documents before the block.

    Only the totals of the shards (as many as shuffle partitions) come to the driver."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    totals = sorted(blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())
    before, at = [], 0
    for shard, n in totals:
        before.append((shard, at))
        at += n
    starts = spark.createDataFrame(before, "shard int, shard_start long")
    return blocks.join(F.broadcast(starts), "shard").withColumn("start", F.col("shard_start") + F.col("base")).drop("shard_start")


def store_documents(spark, path: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32), one per document, read from a store."""
    names = [c.split()[0] for c in BLOCK_SCHEMA.split(", ") if c.split()[0] not in ("shard", "block", "base", "n_ids")]

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                r = {k: batch.column(k)[row].as_py() for k in ["start", *names]}
                n, n_null = r["n_docs"], r["n_null"]
                code = lambda name, n: EliasFano(n, *(r[f"{name}_{x}"] for x in ("low_bits", "low", "high", "samples")))
                end, doc = code("end", n), code("doc", n - n_null)
                ids = np.frombuffer(r["ids"], "<u2" if r["width"] == 2 else "<u4")
                stops = [end.select(i) for i in range(n)]
                starts = [0, *stops[:-1]]
                doc_ids = [None] * n_null + [r["first"] + int(x) for x in doc.all()]
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts, stops)]
                lo, hi = np.array(starts, np.int64), np.array(stops, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(lo + r["start"]), pa.array(hi - lo), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return read_store(spark, path).select("start", *names).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_store(docs: DataFrame, tokenizer_file: str, path: str | None = None) -> DataFrame:
    """Writes a store (in the shared folder unless ``path`` is given) and reads it back."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")
    write_store(docs, path, tokenizer_file)
    return store_documents(spark, path)
