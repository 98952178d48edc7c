"""Operator 4: nearest neighbours by low-dimensional stable projections and a kd-tree.

Vectors are projected to M dimensions by a Gaussian (2-stable) matrix: the projected squared
distance over the true one follows a chi-square law with M degrees of freedom. A kd-tree over
the projections (its planes come from a bounded sample, every vector is filed in it) gives
projected neighbours in order: leaves by the distance to their boxes, vectors within leaves by
their own. Each is verified with its true distance, until the next projected distance d passes
the test d^2 > quantile * kth^2, where kth is the k-th best true distance so far: a
vector nearer than that would have stopped the search with a chance of 1 - CONFIDENCE only.

Three rounds: each query first searches its own leaf, which bounds kth; then the NEAR leaves of nearest
boxes that the test leaves open, which lowers kth; then all others that it leaves open. Leaves are joined to queries by key; large leaves are dealt out in parts
and many queries in chunks, so no group grows with the input.

Equal vectors are one entry with its k + 1 smallest ids: more can't appear in an answer.

Defined results: vectors that are null, empty, zero, or hold nulls or non-finite numbers take no
part, nor do those of another length than most; a query's own id is no candidate; ties
go to the smaller id; repeated rows with one id count once (different vectors under one id are searched and
found each by itself, and answers of one id are merged); no query, no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

M, CONFIDENCE, K, NEAR = 24, 0.9, 10, 8
#: Bound of the sample from which the tree's planes come; vectors in a leaf, about.
SAMPLE_ROWS, LEAF_ROWS = 20_000, 2_000
#: Vectors and queries in one task's group at most, about.
PART_ROWS, CHUNK_QUERIES = 50_000, 10_000
RESULT = "query_id long, vec_id long, score double"


def chi2_quantile(p: float, m: int) -> float:
    """Of the chi-square law with an even number m of degrees of freedom, by bisection."""
    if m % 2:
        raise ValueError("m must be even")
    cdf = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))
    lo, hi = 0.0, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


class KdTree:
    """Planes of a balanced tree as arrays; node i has children 2i + 1 and 2i + 2."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth, m = depth, points.shape[1]
        n = (1 << depth) - 1
        self.axis, self.cut = np.zeros(n, np.int64), np.zeros(n)
        boxes = {0: (np.full(m, -np.inf), np.full(m, np.inf))}
        rows = {0: np.arange(len(points))}
        for i in range(n):
            own, (low, high) = rows.pop(i), boxes.pop(i)
            axis = int(np.argmax(np.ptp(points[own], axis=0))) if len(own) else 0
            cut = float(np.median(points[own, axis])) if len(own) else 0.0
            self.axis[i], self.cut[i] = axis, cut
            right = points[own, axis] > cut
            for child, mine, edge in ((2 * i + 1, ~right, 1), (2 * i + 2, right, 0)):
                box = (low.copy(), high.copy())
                box[edge][axis] = cut
                rows[child], boxes[child] = own[mine], box
        self.low = np.array([boxes[n + i][0] for i in range(n + 1)])
        self.high = np.array([boxes[n + i][1] for i in range(n + 1)])

    def leaf(self, points: np.ndarray) -> np.ndarray:
        at = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            right = points[np.arange(len(points)), self.axis[at]] > self.cut[at]
            at = 2 * at + 1 + right
        return at - len(self.axis)

    def box_distances(self, point: np.ndarray) -> np.ndarray:
        """Squared distances from a point to all leaves' boxes."""
        out = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        return (out * out).sum(axis=1)


def usable(vec: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vec.isNotNull() & ~F.exists(vec, bad) & F.exists(vec, lambda x: x != 0)


def _stack(column) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _search(q: np.ndarray, qp: np.ndarray, own: int, vectors: np.ndarray, projected: np.ndarray, ids: list, k: int, limit: float, kth: float):
    """The incremental search in one leaf: (distance, id) pairs, at most k, none beyond kth."""
    d2 = ((projected - qp) ** 2).sum(axis=1)
    order = np.argsort(d2, kind="stable")
    best: list[tuple[float, int]] = []
    for lo in range(0, len(order), 128):
        rows = order[lo : lo + 128]
        if d2[rows[0]] > limit * kth * kth:
            break
        diff = vectors[rows] - q
        dist = np.sqrt((diff * diff).sum(axis=1))
        for at in np.flatnonzero(dist <= kth):
            best += [(float(dist[at]), int(i)) for i in ids[rows[at]] if i != own]
        best = sorted(best)[:k]
        if len(best) == k:
            kth = min(kth, best[-1][0])
    return best


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, m: int = M,
            confidence: float = CONFIDENCE, seed: int = 5) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k nearest found of each query."""
    spark = vectors.sparkSession
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.col(vec_col).cast("array<double>").alias("vec"))
    v = v.filter(usable(F.col("vec")) & F.col("id").isNotNull()).withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0)))
    lengths = v.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = lengths[0]
    v = v.filter(F.size("vec") == dim)
    # The limit on ranks is applied before the shuffle too, so one very common vector meets no single task.
    rank = F.dense_rank().over(Window.partitionBy("vec").orderBy("id"))
    entries = v.select("id", "vec").withColumn("rank", rank).filter(F.col("rank") <= k + 1).groupBy("vec").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    entries = materialize(entries, "vectors")
    n = entries.count()
    sample = entries.select("vec").orderBy(F.xxhash64("vec")).limit(SAMPLE_ROWS).toPandas()
    matrix = np.random.default_rng(seed).standard_normal((dim, m))
    points = _stack(sample["vec"]) @ matrix
    depth = max(0, min(math.ceil(math.log2(max(1, n / LEAF_ROWS))), int(math.log2(max(1, len(points) / 8)))))
    tree = KdTree(points, depth)
    sent = spark.sparkContext.broadcast((tree, matrix))  # at most SAMPLE_ROWS / 8 boxes
    limit = chi2_quantile(confidence, m)

    def file(pdfs):
        tree, matrix = sent.value
        for pdf in pdfs:
            pdf["leaf"] = tree.leaf(_stack(pdf["vec"]) @ matrix) if len(pdf) else np.zeros(0, np.int64)
            yield pdf

    filed = materialize(entries.mapInPandas(file, "vec array<double>, ids array<long>, leaf long"), "filed")
    queries = v.filter("asks").select("id", "vec").dropDuplicates()
    asked = materialize(queries.mapInPandas(file, "id long, vec array<double>, leaf long"), "queries")
    # One row for each leaf: into how many parts it is dealt.
    parts = filed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("parts"))
    parts = materialize(parts, "parts")

    def search(key, data, ask):
        if not len(data) or not len(ask):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        _, matrix = sent.value
        vec, ids = _stack(data["vec"]), list(data["ids"])
        projected = vec @ matrix
        q = _stack(ask["vec"])
        qp = q @ matrix
        out = [(own, i, d) for own, a, b, kth in zip(ask["id"], q, qp, ask["kth"]) for d, i in _search(a, b, own, vec, projected, ids, k, limit, kth)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    def visit(ask: DataFrame) -> DataFrame:
        """ask: (id, vec, leaf, kth) rows, one for each query and leaf."""
        chunks = ask.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / CHUNK_QUERIES).cast("int").alias("chunks"))
        plan = materialize(parts.join(chunks, "leaf"), "plan")  # a row for each leaf
        plan = F.broadcast(plan)
        data = filed.join(plan, "leaf").withColumn("part", F.pmod(F.xxhash64("vec"), F.col("parts")).cast("int"))
        data = data.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("leaf", "part", "chunk", "vec", "ids")
        asks = ask.join(plan, "leaf").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
        asks = asks.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("leaf", "part", "chunk", "id", "vec", "kth")
        key = ["leaf", "part", "chunk"]
        return data.groupBy(*key).cogroup(asks.groupBy(*key)).applyInPandas(search, RESULT)

    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))

    def bounded(found: DataFrame) -> DataFrame:
        """asked with kth, the k-th best distance found so far."""
        best = found.withColumn("rank", place).filter(f"rank = {k}").select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
        return asked.join(best, "id", "left").withColumn("kth", F.coalesce("kth", F.lit(float("inf"))))

    def open_leaves(found: DataFrame, first: int, last: int | None) -> DataFrame:
        """The open leaves of each query, from the first to the last by the distance of their boxes; its own aside."""

        def run(pdfs):
            tree, matrix = sent.value
            for pdf in pdfs:
                leaves = []
                for vec, home, kth in zip(pdf["vec"], pdf["leaf"], pdf["kth"]):
                    away = tree.box_distances(np.asarray(vec) @ matrix)
                    order = np.argsort(away, kind="stable")
                    some = order[order != home][first:last]
                    leaves.append(some[away[some] <= limit * kth * kth])
                pdf["leaf"] = leaves
                yield pdf

        rows = bounded(found).select("id", "vec", "leaf", "kth").mapInPandas(run, "id long, vec array<double>, leaf array<long>, kth double")
        return materialize(rows.withColumn("leaf", F.explode("leaf")), "open-leaves")

    found = materialize(visit(asked.withColumn("kth", F.lit(float("inf")))), "home")
    if depth:
        for first, last in ((0, NEAR), (NEAR, None)):
            found = materialize(found.unionByName(visit(open_leaves(found, first, last))), "found")
    found = found.dropDuplicates(["query_id", "vec_id", "score"])
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
