"""Composite index, shrinkage, clusters, regressions, rankings, sensitivity and bias diagnostics."""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import IndexRules
from ..functions import stats
from ..operators import windows
from ..operators.aggregate import mean_of_known

COMPONENTS = ("talent", "quality", "vulnerability")


def shrunk_rate(df: DataFrame, count: str, population: str, prior: float = 20_000.0, out: str = "taxa_suavizada") -> DataFrame:
    """Rate per 100k drawn to the overall rate by ``prior`` inhabitants; the overall rate is one broadcast row."""
    overall = df.agg((F.sum(count) / F.sum(population)).alias("__r0"))
    return df.crossJoin(F.broadcast(overall)).withColumn(out, (F.col(count) + prior * F.col("__r0")) / (F.col(population) + prior) * 1e5).drop("__r0")


def shrunk_mean(df: DataFrame, value: str, n: str, k: float = 30.0, out: str = "valor_suavizado") -> DataFrame:
    """Value drawn to the plain mean of all rows by k observations."""
    overall = df.agg(F.avg(value).alias("__mean"))
    return df.crossJoin(F.broadcast(overall)).withColumn(out, (F.col(n) * F.col(value) + k * F.col("__mean")) / (F.col(n) + k)).drop("__mean")


def components(df: DataFrame, talent: str, quality: list[str], income: str, rules: IndexRules = IndexRules(), how: str = "rank") -> DataFrame:
    """Component scores between 0 and 1; quality is the mean of its known parts, vulnerability falls with income."""
    scaled = {talent: "talent", income: "__income"} | {q: f"__q{i}" for i, q in enumerate(quality)}
    base = df
    for value, out in scaled.items():  # every rank comes from the input itself, so the plan grows by one join each
        df = windows.with_ranks(df, value, windows.rank_table(base, value, out, percent=True)) if how == "rank" else windows.global_min_max(df, value, out)
    names = [f"__q{i}" for i in range(len(quality))]
    q = mean_of_known(*map(F.col, names))
    return df.withColumns({"quality": q if rules.quality_sign > 0 else 1 - q, "vulnerability": 1 - F.col("__income")}).drop(*names, "__income")


def weighted_index(parts: dict[str, Column], weights: dict[str, Column], least: int) -> Column:
    """Mean of the known components by their weights; null if fewer than ``least`` are known."""
    known = sum((parts[c].isNotNull().cast("int") for c in parts), F.lit(0))
    total = sum((F.when(parts[c].isNotNull(), weights[c]).otherwise(0.0) for c in parts), F.lit(0.0))
    value = sum((F.coalesce(parts[c] * weights[c], F.lit(0.0)) for c in parts), F.lit(0.0))
    return F.when(known >= least, F.round(F.try_divide(value, total), 12))  # weights that differ by a factor alone keep ties


def composite_index(df: DataFrame, rules: IndexRules = IndexRules(), out: str = "indice") -> DataFrame:
    return df.withColumn(out, weighted_index({c: F.col(c) for c in COMPONENTS}, {c: F.lit(w) for c, w in rules.weights}, rules.min_components))


def scenarios(rules: IndexRules = IndexRules(), step: float = 0.2) -> list[tuple[str, float, float, float]]:
    """Weights 20 % up and down in all combinations but the base, and each weight at zero."""
    base = dict(rules.weights)
    rows = []
    for f in product((1 - step, 1.0, 1 + step), repeat=3):
        if f != (1.0, 1.0, 1.0):
            rows.append(("x".join(f"{x:g}" for x in f), *[base[c] * x for c, x in zip(COMPONENTS, f)]))
    rows += [(f"sem_{c}", *[0.0 if c == d else base[d] for d in COMPONENTS]) for c in COMPONENTS]
    return rows


def sensitivity(df: DataFrame, entity: str, rules: IndexRules = IndexRules(), tops: tuple[int, ...] = (50, 100, 200), scaled: DataFrame | None = None) -> DataFrame:
    """By scenario: Spearman correlation with the base ranking, overall and inside each top N of the base, and the share
    of each top N that stays. scaled: the components by another scaling (entity and COMPONENTS), as scenario ``minmax``.

    The scenarios (some thirty rows) are broadcast; ranks are windows by scenario; ties go by entity."""
    table = F.broadcast(df.sparkSession.createDataFrame(scenarios(rules), "cenario string, w0 double, w1 double, w2 double"))
    base = composite_index(df, rules).filter("indice IS NOT NULL").select(entity, "indice", *COMPONENTS)
    value = weighted_index({c: F.col(c) for c in COMPONENTS}, {c: F.col(f"w{i}") for i, c in enumerate(COMPONENTS)}, rules.min_components)
    every = base.crossJoin(table).select("cenario", entity, "indice", value.alias("__alt"))
    if scaled is not None:
        other = composite_index(scaled, rules, "__alt").select(entity, "__alt")
        every = every.unionByName(base.join(other, entity).select(F.lit("minmax").alias("cenario"), entity, "indice", "__alt"))
    place = lambda c: F.row_number().over(Window.partitionBy("cenario").orderBy(F.desc(c), entity))
    every = every.withColumns({"__b": windows.average_rank("indice", ["cenario"], True), "__c": windows.average_rank("__alt", ["cenario"], True), "__pb": place("indice"), "__pc": place("__alt")})
    out = [F.corr("__b", "__c").alias("spearman_geral")]
    for n in tops:
        inside = F.col("__pb") <= n
        own = Window.partitionBy("cenario", inside)
        for c in "bc":
            ranked = F.rank().over(own.orderBy(f"__{c}")) + (F.count(F.lit(1)).over(Window.partitionBy("cenario", inside, f"__{c}")) - 1) / 2
            every = every.withColumn(f"__{c}{n}", F.when(inside, ranked))
        out += [(F.count(F.when(inside & (F.col("__pc") <= n), 1)) / n).alias(f"retencao_top{n}"), F.corr(f"__b{n}", f"__c{n}").alias(f"spearman_top{n}")]
    return every.groupBy("cenario").agg(*out)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    both = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = windows.with_ranks(windows.global_rank(both, a, "__a"), b, windows.rank_table(both, b, "__b"))
    return ranked.agg(F.corr("__a", "__b").alias("spearman"), F.count(F.lit(1)).alias("n"))


def kruskal_wallis(df: DataFrame, group: str, value: str) -> DataFrame:
    """H with tie correction and its chi-square tail; the ranks and sums are distributed, one row comes out."""
    rows = windows.global_rank(df.filter(F.col(group).isNotNull() & F.col(value).isNotNull()), value, "__r")
    sums = rows.groupBy(group).agg(F.sum("__r").alias("r"), F.count(F.lit(1)).alias("n"))
    ties = rows.groupBy(value).agg(F.count(F.lit(1)).cast("double").alias("t")).agg(F.sum(F.col("t") ** 3 - F.col("t")).alias("ties"))
    h = sums.agg(F.sum(F.col("r") ** 2 / F.col("n")).alias("s"), F.sum("n").cast("double").alias("n"), F.count(F.lit(1)).alias("k")).crossJoin(F.broadcast(ties))
    n = F.col("n")
    h = h.select(((12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / (1 - F.col("ties") / (n**3 - n))).alias("h"), (F.col("k") - 1).alias("gl"))
    row = h.first()
    p = stats.chi2_sf(row["h"], row["gl"]) if row and row["h"] is not None else None
    return df.sparkSession.createDataFrame([(row["h"], row["gl"], p)], "h double, gl long, p double")


def bias_table(df: DataFrame, group: str, value: str, complete: str | None = None, share: float = 0.9) -> DataFrame:
    """By group: rows, mean, share in the top decile, share with a value, and over-representation in the top."""
    cut = df.agg(F.percentile(value, share).alias("__cut"), F.count(value).alias("__n"))
    top = F.coalesce(F.col(value) >= F.col("__cut"), F.lit(False)).cast("double")
    rows = df.crossJoin(F.broadcast(cut)).withColumn("__top", top)
    out = rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("media"), F.try_divide(F.sum("__top"), F.count(value)).alias("parcela_topo"),
        F.avg(F.col(complete or value).isNotNull().cast("double")).alias("completude"), F.sum("__top").alias("__t"), F.count(value).alias("__v"),
    )
    all_ = Window.partitionBy(F.lit(0))
    ratio = F.try_divide(F.col("__t") / F.sum("__t").over(all_), F.col("__v") / F.sum("__v").over(all_))
    return out.withColumn("razao_representacao", ratio).drop("__t", "__v")


def sex_gap(df: DataFrame, keys: list[str], sex: str, value: str, weight: str) -> DataFrame:
    """Weighted means by sex and their difference."""
    m = {s: F.try_divide(F.sum(F.when(F.col(sex) == s, F.col(value) * F.col(weight))), F.sum(F.when((F.col(sex) == s) & F.col(value).isNotNull(), F.col(weight)))) for s in "FM"}
    return df.groupBy(*keys).agg(m["F"].alias("media_f"), m["M"].alias("media_m")).withColumn("diferenca", F.col("media_m") - F.col("media_f"))


def precision_recall(df: DataFrame, predicted: str, truth: str, weight: str | None = None) -> DataFrame:
    """Precision and recall of a 0/1 prediction over rows with a label, weighted if asked."""
    w = F.col(weight) if weight else F.lit(1.0)
    s = lambda p: F.sum(F.when(p, w).otherwise(0.0))
    p, t = F.col(predicted) == 1, F.col(truth) == 1
    return df.filter(F.col(truth).isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.try_divide(s(p & t), s(p)).alias("precisao"), F.try_divide(s(p & t), s(t)).alias("cobertura")
    )


def link_precision(labelled: DataFrame, strata: DataFrame) -> DataFrame:
    """Share of right links by status in the labelled sample, and reweighted to the sizes of the strata.

    labelled: link_status, correto ('0', '1' or blank), strata: link_status, n_linhas."""
    right = F.when(F.trim("correto") == "1", 1.0).when(F.trim("correto") == "0", 0.0)
    per = labelled.withColumn("__r", right).groupBy("link_status").agg(F.count("__r").alias("rotulados"), F.avg("__r").alias("precisao"))
    joined = strata.join(per, "link_status", "left")
    all_ = Window.partitionBy(F.lit(0))
    weighted = F.sum(F.col("precisao") * F.col("n_linhas")).over(all_) / F.sum(F.when(F.col("precisao").isNotNull(), F.col("n_linhas"))).over(all_)
    return joined.withColumn("precisao_ponderada", weighted)


#: Below so many distinct points silhouettes are measured at once; above, k is first chosen by bounds.
_FEW_POINTS = 20_000


def kmeans(df: DataFrame, entity: str, features: list[str], ks: tuple[int, ...] = tuple(range(3, 9)), seed: int = 42, restarts: int = 10):
    """(rows with cluster, table of k with silhouette and Davies-Bouldin). The best k has the largest silhouette.

    Fitting is distributed. Equal rows are one point with a weight; the distinct points are sent to all tasks, which
    measure their share. The table's silhouettes are exact, which takes all pairs of distinct points: of many points they are
    measured when the table is read. The best k takes bounds on them, made narrower until one k is above all others."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    spark = df.sparkSession
    # by number, as narrow rows would be put together in few partitions and fitted on few cores; in order, so that reruns start alike
    rows = df.dropna(subset=features).repartition(spark.sparkContext.defaultParallelism, entity).sortWithinPartitions(entity)
    vec = VectorAssembler(inputCols=features, outputCol="__raw").transform(rows)
    scaled = StandardScaler(inputCol="__raw", outputCol="__v", withMean=True).fit(vec).transform(vec).persist()
    found, every, fitted = {}, scaled, scaled.select("__v")  # not the stored table itself, so that a fit keeps the norms
    for k in ks:
        models = [KMeans(k=k, seed=seed + r, featuresCol="__v", predictionCol="cluster").fit(fitted) for r in range(restarts)]
        found[k] = min(models, key=lambda m: m.summary.trainingCost)
        every = found[k].transform(every).withColumnRenamed("cluster", f"__k{k}")
    place = [vector_to_array("__v")[i].alias(f"__p{i}") for i in range(len(features))]
    names = [f"__k{k}" for k in ks]
    got = every.select(*place, *names).groupBy(*[f"__p{i}" for i in range(len(features))], *names).agg(F.count(F.lit(1)).alias("__w")).toArrow()
    points = np.column_stack([got[f"__p{i}"].to_numpy() for i in range(len(features))])
    weights, labels = got["__w"].to_numpy().astype(float), {k: got[f"__k{k}"].to_numpy() for k in ks}
    best, silhouettes = _best(spark, stats.Places(points, weights, labels))
    other = spark.createDataFrame([(int(k), stats.davies_bouldin(points, labels[k], weights)) for k in ks], "k int, davies_bouldin double")
    table = silhouettes.join(F.broadcast(other), "k").select("k", "silhueta", "davies_bouldin")
    return found[best].transform(scaled).drop("__raw", "__v"), table


def _best(spark, places: stats.Places) -> tuple[int, DataFrame]:
    """(the k of the largest silhouette, the first of equal ones; exact rows k, silhueta)."""
    many = len(places.points) > _FEW_POINTS
    sent = spark.sparkContext.broadcast(places.grow() if many else places)
    exact = _silhouettes(spark, sent).select("k", F.col("low").alias("silhueta"))
    if many:
        for theta in (0.4, 0.2, 0.1):
            ends = {r.k: r for r in _silhouettes(spark, sent, theta).collect()}
            best = max(places.ks, key=lambda k: ends[k].low)
            if all(ends[best].low - 1e-9 > ends[k].high for k in places.ks if k != best):
                return best, exact
    found = _all_pairs(exact)
    return max(places.ks, key=lambda k: found[k]), spark.createDataFrame(list(found.items()), "k int, silhueta double")


def _all_pairs(exact: DataFrame) -> dict[int, float]:
    return {r.k: r.silhueta for r in exact.collect()}


def _silhouettes(spark, sent, theta: float | None = None) -> DataFrame:
    """Rows (k, low, high): bounds of each labelling's mean silhouette, equal and exact without ``theta``. Tasks take leaves of the places sent."""
    import pyarrow as pa

    def measure(batches):
        p = sent.value
        for batch in batches:
            for block in batch.column(0).to_pylist():
                rows = p.rows(block)
                out = p.scores(rows, p.direct(rows, np.arange(len(p.points)))) if theta is None else p.scores(rows, *p.bounds(block, theta))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["k", "low", "high"])

    places = sent.value
    tasks = min(places.blocks(), 4 * spark.sparkContext.defaultParallelism)
    sums = spark.range(0, places.blocks(), 1, tasks).mapInArrow(measure, "k long, low double, high double")
    mean = lambda c: (F.sum(c) / float(places.weights.sum())).alias(c)
    return sums.groupBy(F.col("k").cast("int").alias("k")).agg(mean("low"), mean("high"))


def cluster_profile(df: DataFrame, features: list[str], cut: float = 0.5) -> DataFrame:
    """Mean of each feature by cluster, and a label of those at least ``cut`` deviations off the overall mean."""
    overall = df.agg(*[x for f in features for x in (F.avg(f).alias(f"__m_{f}"), F.stddev_pop(f).alias(f"__s_{f}"))])
    per = df.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.avg(f).alias(f) for f in features]).crossJoin(F.broadcast(overall))
    z = {f: F.try_divide(F.col(f) - F.col(f"__m_{f}"), F.col(f"__s_{f}")) for f in features}
    marks = [F.when(z[f] >= cut, F.lit(f"{f} alto")).when(z[f] <= -cut, F.lit(f"{f} baixo")) for f in features]
    return per.select("cluster", "n", *features, F.concat_ws(", ", *marks).alias("rotulo"))


def one_hot(df: DataFrame, column: str, levels: list[str]) -> tuple[DataFrame, list[str]]:
    """0/1 columns for all levels but the first, in sorted order; null is the first too."""
    names = {f"{column}={v}": v for v in sorted(levels)[1:]}
    return df.withColumns({n: F.coalesce((F.col(column) == v).cast("double"), F.lit(0.0)) for n, v in names.items()}), list(names)


def least_squares(df: DataFrame, entity: str, target: str, features: list[str], folds: int = 5):
    """OLS with an intercept: (rows entity, esperado, residuo; cross-validated goodness; coefficients with p-values).

    Sums of products by fold (a hash of the entity) are all that reaches the driver; residuals are columns."""
    rows = df.select(entity, F.col(target).cast("double").alias("__y"), *[F.col(f).cast("double").alias(f"__x{i}") for i, f in enumerate(features)]).dropna()
    rows = rows.withColumn("__f", F.pmod(F.xxhash64(F.lit(42), entity), F.lit(folds)))
    names = [f"__x{i}" for i in range(len(features))]
    means = rows.agg(*[F.avg(c).alias(c) for c in names]).first()
    centre = [0.0 if m is None else m for m in means]
    terms = [F.lit(1.0), *[F.col(c) - m for c, m in zip(names, centre)]]
    p = len(terms)
    products = [F.sum(a * b).alias(f"s{i}_{j}") for i, a in enumerate(terms) for j, b in enumerate([*terms, F.col("__y")]) if j >= i]
    xx, xy = np.zeros((folds, p, p)), np.zeros((folds, p))
    for row in rows.groupBy("__f").agg(*products).collect():  # a row for each fold
        for i in range(p):
            xy[row["__f"], i] = row[f"s{i}_{p}"]
            for j in range(i, p):
                xx[row["__f"], i, j] = xx[row["__f"], j, i] = row[f"s{i}_{j}"]
    inverse = np.linalg.pinv(xx.sum(axis=0))
    beta = inverse @ xy.sum(axis=0)
    line = lambda b: sum((F.lit(float(w)) * t for w, t in zip(b, terms)), F.lit(0.0))
    left_out = F.lit(None).cast("double")
    for f in range(folds):
        left_out = F.when(F.col("__f") == f, line(np.linalg.pinv(xx.sum(axis=0) - xx[f]) @ (xy.sum(axis=0) - xy[f]))).otherwise(left_out)
    rows = rows.withColumns({"esperado": line(beta), "__cv": F.col("__y") - left_out})
    error = F.col("__y") - F.col("esperado")
    sums = rows.agg(F.sum(error * error), F.count(F.lit(1)), F.sum(F.col("__cv") ** 2), F.sum(F.abs("__cv")), F.var_pop("__y")).first()
    rss, n, cv2, cv1, variance = (x or 0.0 for x in sums)
    scale = rss / max(1, n - np.linalg.matrix_rank(xx.sum(axis=0)))
    back = np.eye(p)
    back[0, 1:] = [-m for m in centre]
    shown, spread = back @ beta, np.sqrt(np.maximum(np.diag(back @ inverse @ back.T) * scale, 1e-300))
    coefficients = [(name, float(b), stats.student_sf2(b / e, max(1, n - p))) for name, b, e in zip(["const", *features], shown, spread)]
    goodness = {"r2": 1 - cv2 / (variance * n) if variance else float("nan"), "rmse": float(np.sqrt(cv2 / max(1, n))), "mae": cv1 / max(1, n)}
    return rows.select(entity, "esperado", (error / float(np.sqrt(max(scale, 1e-300)))).alias("residuo")), goodness, coefficients


def regression(df: DataFrame, entity: str, target: str, features: list[str], exposure: str | None = None):
    """(rows entity, esperado, residuo; cross-validated goodness; coefficients). OLS, or negative binomial with an exposure.

    The negative binomial's matrix (a row for each municipality) is brought to the driver; its alpha is sought
    between 1e-4 and 50."""
    if exposure is None:
        return least_squares(df, entity, target, features)
    data = df.select(entity, target, *features, exposure).dropna().orderBy(entity).toPandas()
    x, y = data[features].to_numpy(float), data[target].to_numpy(float)
    e = data[exposure].to_numpy(float)
    fit = stats.nb2(x, y, e)
    design = lambda a: np.column_stack([np.ones(len(a)), a])
    predicted = stats.cv_predict(lambda a, b, new, rows, fresh: np.exp(design(new) @ stats.nb2(a, b, e[rows])["beta"]) * e[fresh], x, y)
    spark = df.sparkSession
    kind = dict(df.dtypes)[entity]
    cast = int if kind in ("int", "bigint", "smallint") else str
    out = spark.createDataFrame([(cast(a), float(b), float(c)) for a, b, c in zip(data[entity], fit["mu"], fit["pearson"])], f"{entity} {kind}, esperado double, residuo double")
    return out, stats.goodness(y, predicted), [(n, float(b), float(fit["alpha"])) for n, b in zip(["const", *features], fit["beta"])]


def residual_table(parts: list[DataFrame]) -> DataFrame:
    """Long residuals (entidade_id, tipo, metrica, etapa, residuo) ranked by type, metric and stage; flagged above 1."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    ranked = windows.competition_rank(out, ["tipo", "metrica", "etapa"], "residuo")
    return ranked.withColumn("acima_do_esperado", F.col("residuo") > 1)


def ranking_table(parts: list[DataFrame], n_min: int = 10) -> DataFrame:
    """(entidade_id, tipo, recorte, metrica, valor, n) ranked by type, slice and metric; small cells are left out."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    shown = out.filter(F.col("valor").isNotNull() & (F.coalesce(F.col("n"), F.lit(n_min)) >= n_min))
    return windows.competition_rank(shown, ["tipo", "recorte", "metrica"], "valor")


def reference_years(df: DataFrame, by: str, year: str = "ano") -> DataFrame:
    return df.groupBy(by).agg(F.max(year).alias("ultimo"), F.sort_array(F.collect_set(year)).alias("anos"))
