import re
from collections import defaultdict

import numpy as np

from meridia.llm import mixing

from .conftest import SCHEMA, as_dict


def brute_targets(sizes, cap=3):
    """Sources by code point, null last; the rule word for word: give out by weight, cap, give the excess out again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target = {s: 0.0 for s in names}
    left, open_ = float(sum(sizes.values())), set(names)
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in list(open_):
            target[s] += left * weight[s] / total
        left = 0.0
        for s in list(open_):
            if target[s] > cap * sizes[s]:
                left += target[s] - cap * sizes[s]
                target[s] = float(cap * sizes[s])
                open_.discard(s)
    return target


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def check(rows, got):
    sizes = defaultdict(int)
    for _, t, _, s, _ in rows:
        sizes[s] += words(t)
    want = brute_targets(sizes)
    taken = defaultdict(int)
    assert len(got) == len(rows)
    for i, t, _, s, _ in rows:
        r = got[i]
        assert r["size"] == words(t) and r["source_size"] == sizes[s]
        assert abs(r["target"] - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.5
    return want


def test_mix_meets_targets_exactly(docs, rows):
    got = as_dict(mixing.mix(docs))
    check(rows, got)
    assert got == as_dict(mixing.mix(docs.repartition(7)))


def test_random_targets_agree_with_brute_force(spark):
    rng = np.random.default_rng(1)
    for _ in range(3):
        sizes = {f"s{i}": int(x) for i, x in enumerate(rng.integers(0, 10 ** rng.integers(1, 6), 9))} | {None: 5}
        df = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got = {r.source: r.target for r in mixing.source_targets(df).collect()}
        want = brute_targets(sizes)
        assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in sizes)


def test_prefix_sums_across_partitions(spark):
    rows = [(i, None if i % 5 == 0 else "hot" if i % 5 < 4 else f"s{i % 3}", i % 7, (i * 7919) % 101) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, key long")
    got = {r.doc_id: r.prefix for r in mixing.prefix_sums(df).collect()}
    for s in {r[1] for r in rows}:
        at = 0
        for i, _, size, _ in sorted((r for r in rows if r[1] == s), key=lambda r: (r[3], r[0])):
            assert got[i] == at
            at += size


def test_mix_extra_columns_empty_and_sizeless(clashing, empty, spark, rows):
    check(rows, as_dict(mixing.mix(clashing)))
    assert mixing.mix(empty).count() == 0
    got = mixing.mix(spark.createDataFrame([(1, None, None, None, 0), (2, " ", None, "a", 1)], SCHEMA)).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0), (0, 0.0, 0)]


def test_mix_documents_repeats_whole_documents(clashing, rows):
    out = mixing.mix_documents(clashing)
    assert out.columns == clashing.columns
    sizes, got = defaultdict(int), defaultdict(int)
    for _, t, _, s, _ in rows:
        sizes[s] += words(t)
    largest = {s: max(words(t) for _, t, _, s2, _ in rows if s2 == s) for s in sizes}
    texts = {i: t for i, t, *_ in rows}
    for r in out.collect():
        assert r.text == texts[r.doc_id]
        got[r.source] += words(r.text)
    want = brute_targets(sizes)
    for s in sizes:
        assert abs(got[s] - want[s]) <= largest[s] / 2 + 1
    assert mixing.mix_documents(clashing.limit(0)).count() == 0
