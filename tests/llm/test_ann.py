import numpy as np

from pyspark.sql import functions as F

from meridia.llm import ann

SCHEMA = "vec_id long, embedding array<float>, rank int, ids string"


def make(n=3000, d=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, d)) * 2
    x = (centres[rng.integers(0, 12, n)] + rng.standard_normal((n, d)) * 0.6).astype(np.float32)
    x[200:900] = x[200]  # one very common vector
    return x


def brute(x, ids, queries, k=10):
    out = {}
    x = x.astype(np.float64)
    for q in queries:
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        out[ids[q]] = sorted((float(d[i]), ids[i]) for i in range(len(x)) if ids[i] != ids[q])[:k]
    return out


def frame(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in v], 0, "x") for i, v in enumerate(x)], SCHEMA).repartition(4)


def test_recall_order_and_exact_scores(spark):
    x = make()
    want = brute(x, list(range(len(x))), range(0, len(x), 100))
    got = {}
    for r in ann.nearest(frame(spark, x), F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(want)
    hits = total = 0
    for q, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 11))
        pairs = [(s, i) for _, i, s in rows]
        assert pairs == sorted(pairs) and q not in [i for _, i in pairs]
        for s, i in pairs:
            assert abs(s - np.sqrt(((x[i].astype(float) - x[q].astype(float)) ** 2).sum())) < 1e-12
        hits += len({i for _, i in pairs} & {i for _, i in want[q]})
        total += 10
    assert hits / total >= 0.9


def test_recall_with_64_leaves_on_vectors_without_clusters(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAF_ROWS", 40)
    x = np.random.default_rng(3).standard_normal((2600, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert len(ann.KdTree(x[:, : ann.M].astype(float), 7).low) >= 64  # the depth that 2600 rows and 40 a leaf give
    want = brute(x, list(range(len(x))), range(0, len(x), 100))
    got = {}
    for r in ann.nearest(frame(spark, x), F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert {len(v) for v in got.values()} == {10}
    assert sum(len(got[q] & {i for _, i in want[q]}) for q in want) >= 9 * len(want)


def test_parts_and_chunks_do_not_change_answers(spark, monkeypatch):
    x = make(700)
    a = ann.nearest(frame(spark, x), F.col("vec_id") % 100 == 0).collect()
    monkeypatch.setattr(ann, "PART_ROWS", 40)
    monkeypatch.setattr(ann, "CHUNK_QUERIES", 1)
    b = ann.nearest(frame(spark, x), F.col("vec_id") % 100 == 0).collect()
    assert sorted(a) == sorted(b)


def test_unusable_vectors_ties_and_small_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0]), (7, [2.0, 0.0]), (8, [0.0, -0.0]), (9, [0.0, 0.0 + 1e-30]), (11, [2.0, 0.0]), (100, None), (11, [2.0, 0.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(df, F.col("vec_id") % 100 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 7, 1.0), (0, 2, 9, 1.0), (0, 3, 11, 1.0)]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert ann.nearest(df, F.lit(False)).count() == 0


def test_chi_square_quantile():
    assert abs(ann.chi2_quantile(0.95, 8) - 15.50731) < 1e-4
    assert abs(ann.chi2_quantile(0.5, 2) - 1.386294) < 1e-5


def test_tree_boxes_hold_their_points():
    p = np.random.default_rng(2).standard_normal((500, 4))
    tree = ann.KdTree(p, 4)
    leaf = tree.leaf(p)
    assert len(set(leaf)) == 16
    for v, at in zip(p, leaf):
        assert tree.box_distances(v)[at] == 0
