import random

import xxhash

from meridia.llm import components, simhash
from meridia.llm.common import Scratch

from .conftest import SCHEMA, as_dict

WS = " \t\n\x0b\x0c\r"


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in WS:
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, max_bits=2):
    parent = {i: i for i in fps}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= max_bits:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_near_dedup_agrees_with_brute_force(docs, clashing, empty, rows):
    fps = {i: brute_fingerprint(t) for i, t, *_ in rows}
    root = brute_components(fps)
    want = {i: {"doc_id": i, "fingerprint": f"{fps[i]:016x}", "component_id": root[i]} for i in fps}
    assert len(set(root.values())) < len(root) - 5
    assert as_dict(simhash.near_dedup(docs)) == want
    assert as_dict(simhash.near_dedup(clashing, support=0.02)) == want
    assert simhash.near_dedup(empty).count() == 0


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def random_fps(seed, n=400):
    """Clusters, chains, and a ball dense enough to fill postings beyond any cap."""
    rng = random.Random(seed)
    out = {0, (1 << 64) - 1, 1 << 63}
    while len(out) < n:
        x = rng.getrandbits(64)
        out.add(x)
        for _ in range(rng.randint(0, 4)):
            for _ in range(rng.randint(1, 3)):
                x ^= 1 << rng.randrange(64)
            out.add(x)
    ball = rng.getrandbits(64)
    for _ in range(250):
        x = ball
        for _ in range(rng.randint(0, 4)):
            x ^= 1 << rng.randrange(20)
        out.add(x)
    return sorted(out)


def test_links_at_every_cap_have_the_components_of_all_pairs(spark):
    for seed, cap in ((1, 16), (2, 3), (3, 2)):
        fps = random_fps(seed)
        df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
        found = simhash.links(df, Scratch(spark), cap=cap)
        pairs = [(r.u % (1 << 64), r.v % (1 << 64)) for r in found.collect()]
        assert all(a != b and (a ^ b).bit_count() <= 2 for a, b in pairs)
        want = brute_components({x: x for x in fps})
        roots = {r.node % (1 << 64): r.root % (1 << 64) for r in components.components(found).collect()}
        groups = lambda root: sorted(sorted(v) for v in root.values())
        mine, theirs = {}, {}
        for x in fps:
            mine.setdefault(roots.get(x, x), []).append(x)
            theirs.setdefault(want[x], []).append(x)
        assert groups(mine) == groups(theirs)


def test_one_bit_links(spark):
    fps = random_fps(5, 150)
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    roots = {r.node % (1 << 64): r.root % (1 << 64) for r in components.components(simhash.links(df, Scratch(spark), max_bits=1, cap=2)).collect()}
    want = brute_components({x: x for x in fps}, 1)
    mine, theirs = {}, {}
    for x in fps:
        mine.setdefault(roots.get(x, x), set()).add(x)
        theirs.setdefault(want[x], set()).add(x)
    assert {frozenset(v) for v in mine.values()} == {frozenset(v) for v in theirs.values()}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    random.Random(0).shuffle(edges)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {i: 100 for i in range(101, 130)}


def test_null_ids_and_repeated_rows(spark):
    text = "one two three four five"
    df = spark.createDataFrame([(None, text, None, None, 0), (4, text, None, None, 0), (4, text, None, None, 0), (None, None, None, None, 0)], SCHEMA)
    got = simhash.near_dedup(df).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (-1, 4), (4, 4), (4, 4)]


def test_spark_hash_is_the_contract_hash(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(F.xxhash64(F.lit("anin blé the")).alias("h")).first()
    assert row.h % (1 << 64) == xxhash.xxh64_intdigest("anin blé the".encode(), 42)
