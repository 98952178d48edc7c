import random

from pyspark.sql import functions as F

from meridia.llm import components, shingle_join
from meridia.llm.common import Scratch

from .conftest import SCHEMA


def test_stage_keeps_one_of_each_similar_group(spark, clashing):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, groups = [], []
    for g in range(30):
        base = [word() for _ in range(rng.randint(60, 300))]
        members = []
        for _ in range(1 + g % 4 * 12):
            copy = list(base)
            for at in rng.sample(range(len(copy)), len(copy) // 100):  # similarity of about 0.9 at least
                copy[at] = word()
            members.append(len(rows))
            rows.append((len(rows), " ".join(copy), None, None, 0))
        groups.append(members)
    rows += [(len(rows), None, None, None, 0), (len(rows) + 1, "", None, None, 0), (3, rows[3][1], None, None, 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    kept = sorted(r.doc_id for r in shingle_join.drop_near_copies(df).collect())
    assert kept == sorted([min(m) for m in groups] + [len(rows) - 3])
    out = shingle_join.drop_near_copies(clashing)
    assert out.columns == clashing.columns and out.count() < clashing.count()
    assert shingle_join.drop_near_copies(clashing.limit(0)).count() == 0


def brute_groups(texts, similarity=0.8):
    """Components of all pairs of texts that are that similar in five-word shingles: least number of each."""
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in (t.split() for t in texts)]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for b in range(len(texts)):
        for a in range(b):
            if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in range(len(texts))}


def groups_of(spark, texts):
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    return {r.doc_id: r.component_id for r in shingle_join.similar_groups(df).collect()}


def words_of(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n)]


def test_stage_finds_all_pairs_just_above_the_similarity(spark):
    rng = random.Random(6)
    texts = []
    for i in range(120):
        base = words_of(rng, 304)
        n = 20 + i % 18
        copy = base[:-n] + words_of(rng, n)  # 0.78 to 0.875
        texts += [" ".join(base), " ".join(copy)]
    want = brute_groups(texts)
    assert 80 < len(texts) - len(set(want.values())) < 120
    assert groups_of(spark, texts) == want


def test_stage_finds_all_pairs_among_texts_that_share_long_passages(spark):
    """Postings beyond any cap: of texts like a hub, unlike each other, and unlike all."""
    rng = random.Random(8)
    licence, texts = words_of(rng, 204), []
    for i in range(250):
        own = words_of(rng, 60)
        texts.append(" ".join(licence + own))
        if i % 5 == 0:
            texts.append(" ".join(licence + own[:38] + words_of(rng, 22)))
    parts = [[" ".join(words_of(rng, 9)) for _ in range(3)] for _ in range(12)]
    texts += [" ".join(p[0 if rng.random() < 0.8 else rng.randrange(3)] for p in parts) for _ in range(300)]
    want = brute_groups(texts)
    assert len(set(want.values())) > 200
    assert groups_of(spark, texts) == want


def test_links_at_small_caps_and_blocks_have_the_components_of_all_pairs(spark):
    rng = random.Random(9)
    parts = [[" ".join(words_of(rng, 9)) for _ in range(3)] for _ in range(12)]
    texts = sorted({" ".join(p[0 if rng.random() < 0.7 else rng.randrange(3)] for p in parts) for _ in range(200)})
    root = brute_groups(texts)
    want = sorted(sorted(i for i in root if root[i] == r) for r in set(root.values()))
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(shingle_join.entry_ids(F.col("text"))[0].alias("id"), "text")
    at = {r.id: texts.index(r.text) for r in df.collect()}
    for cap, block in ((2, 3), (5, 256)):
        with Scratch(spark) as scratch:
            roots = components.components(shingle_join.similar_links(df, scratch, 0.8, cap, block)).collect()
        found = {at[r.node]: at[r.root] for r in roots}
        got = [found.get(i, i) for i in range(len(texts))]
        assert sorted(sorted(i for i in root if got[i] == r) for r in set(got)) == want


def test_stage_finds_short_near_copies(spark):
    rng = random.Random(10)
    texts = []
    for i in range(80):
        base = words_of(rng, (8, 9, 10, 16)[i % 4])  # 4 shingles against 5, 5 against 6, 6 against 7, 12 against 15
        texts += [" ".join(base), " ".join(base + words_of(rng, 3 if i % 4 == 3 else 1))]
    texts += ["one two", "one two three", "one  TWO"]
    want = brute_groups([t.lower() for t in texts])
    assert len(texts) - len(set(want.values())) == 81
    assert groups_of(spark, texts) == want


def test_rows_without_id_and_of_one_id(spark):
    rng = random.Random(11)
    a, b, c, d = (" ".join(words_of(rng, 30)) for _ in range(4))
    rows = [(1, a), (None, a), (None, b), (5, c), (5, d), (5, d), (4, c), (None, None), (9, " "), (None, b)]
    df = spark.createDataFrame([(i, t, "en", None, 0) for i, t in rows], SCHEMA)
    kept = [(r.doc_id, r.text) for r in shingle_join.drop_near_copies(df).collect()]
    assert sorted(kept, key=str) == sorted([(1, a), (None, b), (4, c), (5, d), (9, " ")], key=str)
    got = {(r.doc_id, r.component_id) for r in shingle_join.similar_groups(df).collect()}
    assert got == {(1, 1), (None, 1), (None, None), (5, 4), (4, 4), (5, 5), (None, 9), (9, 9)}


def test_postings_streams_runs_over_batches(spark):
    """Runs of every length, with repeated entries, in batches of a few rows."""
    rng = random.Random(12)
    rows = [(k, rng.randrange(20), 9, 1) for k in range(300) for _ in range(rng.choice((1, 1, 2, 3, 40)))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r.k, r.id, r.hub) for r in shingle_join.postings(spark.createDataFrame(rows, "k long, id long, n int, i int")).collect()}
        out = shingle_join.postings(spark.createDataFrame(rows, "k long, id long, n int, i int")).count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    ids = {}
    for k, i, *_ in rows:
        ids.setdefault(k, set()).add(i)
    want = {(k, i, min(s)) for k, s in ids.items() if len(s) > 1 for i in s}
    assert got == want and out == len(want)


def test_sketch_counts_in_one_level_and_two(spark):
    rows = spark.range(5000).withColumn("k", F.xxhash64(F.col("id") % 700)).select("k")
    arrays = lambda batches: (b.column(0).to_numpy() for b in batches)
    one = shingle_join.sketch(rows, arrays)
    spark.conf.set("spark.sql.shuffle.partitions", "520")
    try:
        two = shingle_join.sketch(rows.repartition(9), arrays)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert (one == two).all() and (one > 0).sum() in range(690, 701) and one.max() < 30


def test_keys_tell_shingles_apart_and_nothing_else():
    rng = random.Random(13)
    words = ["a", "b", "ab", "A", "é", "É", "x" * 300, "😀", "b.", "\u00a0", "ba"]
    for n in [0, 1, 3, 4, 5, 6, 9, 40, 700]:
        for _ in range(20):
            w = [rng.choice(words) for _ in range(n)]
            text = rng.choice(["", " ", "\n\t"]) + "".join(x + rng.choice([" ", "  ", "\r\n", "\t\x0b\x0c"]) for x in w)
            low = [x.replace("A", "a") for x in w]
            want = {tuple(low[i : i + 5]) for i in range(max(1, n - 4))} if n else set()
            keys = shingle_join.shingle_keys(text)
            assert len(keys) == len(want)
            assert (keys == shingle_join.shingle_keys(" ".join(low), piece=3)).all()
    assert len(shingle_join.shingle_keys(None)) == 0


def test_a_text_of_a_million_words():
    rng = random.Random(14)
    w = [str(rng.randrange(10**9)) for _ in range(1_000_000)]
    a, b = shingle_join.shingle_keys(" ".join(w)), shingle_join.shingle_keys(" ".join(w[500_000:]))
    assert len(a) == 999_996 and set(b.tolist()) <= set(a.tolist())
    assert len(shingle_join.shingle_keys("x" * 10_000_000 + " y")) == 1


def test_the_fingerprint_index_gives_candidates_and_sets_decide(spark, monkeypatch):
    """Near copies within two bits are dropped by the index alone; close fingerprints of other texts link nothing."""
    from meridia.llm import simhash

    rng = random.Random(12)
    base = [words_of(rng, 1500) for _ in range(6)]
    texts = [" ".join(b) for b in base] + [" ".join([*b[:700], w, *b[701:]]) for b in base for w in words_of(rng, 3)] + ["a b c d e", "a b c d e f g h"]
    fp = [simhash.fingerprint(t, shingle_join.WIDE_SHINGLE) for t in texts]
    close = {(i, j) for j in range(len(texts)) for i in range(j) if ((fp[i] ^ fp[j]) & (2**64 - 1)).bit_count() <= 2}
    assert len(close) > 6
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").repartition(3)
    with Scratch(spark) as scratch:
        pairs = {(r.u, r.v) for r in shingle_join.fingerprint_pairs(df, scratch).collect()}
    assert pairs <= close
    root = list(range(len(texts)))
    for i, j in sorted(pairs):
        a, b = root[i], root[j]
        root = [min(a, b) if x in (a, b) else x for x in root]
    assert all(root[i] == root[j] for i, j in close)

    every = shingle_join.postings
    monkeypatch.setattr(shingle_join, "postings", lambda index: every(index).limit(0))  # no exact join: the index alone
    got = groups_of(spark, texts)
    brute = brute_groups(texts)
    assert all((got[i] == got[j]) <= (brute[i] == brute[j]) for j in range(len(texts)) for i in range(j))
    assert sum(got[i] != i for i in got) >= 6
