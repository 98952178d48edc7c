"""Operator 6: byte-level BPE with the tiktoken library and a local rank file.

Long texts are cut at safe boundaries, before a space that follows a character
other than white space: no match of the splitting pattern spans such a place (a
match has a space only at its start, or is white space only), and the pattern's
only look-ahead is for what follows white space. So the pieces have, end to end, the very
matches of the whole text, and memory is bounded by the piece.

Defined results: null text is an empty text (no ids); decoding gives back the
UTF-8 bytes of the text; null doc_ids and repeated rows each get a result row; an empty table gives
no rows. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Characters in a piece, about; a piece without a safe boundary stays whole.
PIECE_CHARS = 1 << 16
_SAFE = re.compile(r"(?<=\S) ")
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


@functools.lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    """One Encoding for each worker process."""
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines) if a}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """The text in pieces of at least ``size`` characters, cut at safe boundaries."""
    at = 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + max(1, size))
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode(text: str | None, enc, size: int = PIECE_CHARS) -> Iterator[list[int]]:
    for piece in pieces(text or "", size):
        yield enc.encode_ordinary(piece)


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, ids): the ids of each whole text."""

    def run(batches):
        enc = encoding(rank_file, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids = [[i for piece in encode(t, enc) for i in piece] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    d = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return d.mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Rows (doc_id, bytes) from rows (doc_id, ids): the raw bytes, valid UTF-8 or not."""

    def run(batches):
        enc = encoding(rank_file, pattern)
        for batch in batches:
            out = [enc.decode_bytes(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def encode_digests(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every text, and returns digests of both (see SCHEMA).

    The ids never leave the worker: a map over the scan, without a shuffle."""

    def run(batches):
        enc = encoding(rank_file, pattern)
        names = [str(i) for i in range(enc.n_vocab)]
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                counts, ids_hex, bytes_hex = [], [], []
                for text in part.column(1).to_pylist():
                    n, of_ids, of_bytes = 0, hashlib.sha256(), hashlib.sha256()
                    for ids in encode(text, enc):
                        if ids:
                            of_ids.update((("," if n else "") + ",".join([names[i] for i in ids])).encode())
                            of_bytes.update(enc.decode_bytes(ids))
                            n += len(ids)
                    counts.append(n)
                    ids_hex.append(of_ids.hexdigest())
                    bytes_hex.append(of_bytes.hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts, pa.int64()), pa.array(ids_hex), pa.array(bytes_hex)],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    d = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return d.mapInArrow(run, SCHEMA)
