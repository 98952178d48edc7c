import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from meridia.llm import bpe_codec, token_store

from .conftest import SCHEMA, as_dict

RANKS, JSON = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")
ODD = st.text(alphabet=" \n\t\r\x0b\x1c  aB'stélÀ1٣.,!-<|>́😀\x00", max_size=120)
SPECIAL = st.lists(st.sampled_from(["<|endoftext|>", "<|endoftext", "|>", " ", "\n", "a", " b", ".", "<|", "é", "  "]), max_size=40).map("".join)


def test_bpe_round_trip(docs, rows):
    enc = bpe_codec.encoding(RANKS, P.PATTERN)
    got = as_dict(bpe_codec.encode_digests(docs, RANKS, P.PATTERN))
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        ids = enc.encode_ordinary(t or "")
        assert got[i] == {
            "doc_id": i, "n_tokens": len(ids), "ids_sha256": hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            "decoded_sha256": hashlib.sha256((t or "").encode()).hexdigest(),
        }


def test_bpe_encode_then_decode(docs, rows):
    encoded = bpe_codec.encode_documents(docs, RANKS, P.PATTERN)
    back = {r.doc_id: bytes(r.bytes) for r in bpe_codec.decode_documents(encoded, RANKS, P.PATTERN).collect()}
    assert back == {i: (t or "").encode() for i, t, *_ in rows}


def test_decode_gives_raw_bytes(spark):
    ids = [bpe_codec.encoding(RANKS, P.PATTERN).encode_single_token(b"\xff")]
    one = spark.createDataFrame([(1, ids), (2, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: bytes(r.bytes) for r in bpe_codec.decode_documents(one, RANKS, P.PATTERN).collect()} == {1: b"\xff", 2: b""}


@settings(max_examples=300, deadline=None)
@given(ODD, st.integers(0, 12))
def test_pieces_do_not_change_ids(text, size):
    enc = bpe_codec.encoding(RANKS, P.PATTERN)
    assert "".join(bpe_codec.pieces(text, size)) == text
    assert [i for p in bpe_codec.encode(text, enc, size) for i in p] == enc.encode_ordinary(text)


@pytest.fixture(scope="module")
def encoder():
    return token_store.ChunkEncoder(JSON)


@pytest.fixture(scope="module")
def library():
    """The library's own tokenizers: by default, and with special tokens' strings as ordinary text."""
    plain, ordinary = Tokenizer.from_file(JSON), Tokenizer.from_file(JSON)
    ordinary.encode_special_tokens = True
    return plain, ordinary


@pytest.fixture(scope="module")
def ordinary_encoder():
    return token_store.ChunkEncoder(JSON, ordinary=True)


@settings(max_examples=400, deadline=None)
@given(st.one_of(ODD, SPECIAL))
def test_chunks_do_not_change_ids(encoder, ordinary_encoder, library, text):
    for one, want in zip((encoder, ordinary_encoder), library):
        got = np.frombuffer(one.encode([text, None])[0], "<u2").tolist()
        assert got == want.encode(text, add_special_tokens=False).ids


def test_special_token_in_a_text_has_its_id(encoder, ordinary_encoder):
    assert 50256 in np.frombuffer(encoder.encode(["a<|endoftext|> b"])[0], "<u2")
    assert 50256 not in np.frombuffer(ordinary_encoder.encode(["a<|endoftext|> b"])[0], "<u2")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3000), max_size=700))
def test_elias_fano_round_trip(sizes):
    ends = np.cumsum(np.array(sizes, np.int64))
    code = token_store.EliasFano.build(ends)
    again = token_store.EliasFano(len(ends), *code.parts())
    assert again.all().tolist() == ends.tolist()
    for i in range(0, len(ends), 37):
        assert again.select(i) == ends[i]
    if len(ends):
        assert again.select(len(ends) - 1) == ends[-1]
        size = sum(map(len, code.parts()[1:3]))
        assert size <= len(ends) * (3 + np.log2(ends[-1] / len(ends) + 1)) / 8 + 4


def brute_store(rows, tokenizer):
    out, start = {}, 0
    for i, t, *_ in sorted(rows):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        out[i] = {"doc_id": i, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(np.array(ids, "<u4").tobytes())}
        start += len(ids)
    return out


@pytest.mark.parametrize("block_ids", [1, 500, 1 << 20])
def test_store_agrees_with_brute_force(spark, clashing, rows, library, tmp_path, block_ids):
    path = f"file://{tmp_path}/store"
    token_store.write_store(clashing, path, JSON, block_ids=block_ids)
    assert as_dict(token_store.store_documents(spark, path)) == brute_store(rows, library[0])


def test_store_empty_null_and_repeated(spark, empty, encoder):
    assert token_store.token_store(empty, JSON).count() == 0
    df = spark.createDataFrame([(None, "a b", None, None, 0), (3, "x", None, None, 0), (3, "x", None, None, 0)], SCHEMA)
    got = sorted(token_store.token_store(df, JSON).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [(None, 0, 3), (3, 3, 2), (3, 5, 2)]
    far = [-(1 << 63), -5, 0, 7, (1 << 63) - 1]
    df = spark.createDataFrame([(i, "x", None, None, 0) for i in far] + [(None, "y", None, None, 0)], SCHEMA).coalesce(1)
    got = sorted(token_store.token_store(df, JSON).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, *far]


def test_bpe_empty_repeated_null_and_clashing(spark, clashing, rows, empty):
    assert bpe_codec.encode_digests(empty, RANKS, P.PATTERN).count() == 0
    assert len(as_dict(bpe_codec.encode_digests(clashing, RANKS, P.PATTERN))) == len(rows)
    df = spark.createDataFrame([(None, "a b", None, None, 0), (3, "x", None, None, 0), (3, "x", None, None, 0), (4, None, None, None, 0)], SCHEMA)
    got = bpe_codec.encode_digests(df, RANKS, P.PATTERN).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 2), (3, 1), (3, 1), (4, 0)]
