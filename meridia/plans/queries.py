"""Registered queries: the engine's operators on stand-in tables, each with its SQL for the oracle.

Roles: nation = state, customer = municipality, supplier = school, orders = awards (priority =
medal, year of date = edition), lineitem = score rows, part = names. Floats are rounded, as sums
depend on the order of their terms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import domain, similarity, text
from ..operators import aggregate as ag
from ..operators import joins, suppress, windows
from ..sources import html_lists
from ..streaming import audit
from . import linkage, model, serve, star

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r(c, digits: int = 4):
    return F.round(c, digits)


def r_product(c, digits: int):
    """round() as the oracle defines it, on the binary product: 33268.6925 * 1000 lies below its half, so it goes down."""
    return F.round(c * 10.0**digits) / 10.0**digits


def year(c: str):
    return F.year(c).cast("long")


# ---------------------------------------------------------------- cells and suppression
_CELLS = """
    SELECT c_custkey, n_name, year(o_orderdate) AS ano,
           avg(l_extendedprice) FILTER (WHERE l_discount > 0) AS media,
           count(*) FILTER (WHERE l_discount > 0) AS n
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
         JOIN nation ON c_nationkey = n_nationkey
    GROUP BY ALL"""


def city_year_cells(spark, sf) -> DataFrame:
    rows = (
        t(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
        .join(t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t(spark, sf, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    )
    ok = F.col("l_discount") > 0
    return rows.groupBy("c_custkey", "n_name", year("o_orderdate").alias("ano")).agg(ag.exact_mean(F.when(ok, F.col("l_extendedprice"))).alias("media"), F.count(F.when(ok, 1)).alias("n"))


@query(f"""
    WITH cells AS ({_CELLS}),
    shown AS (SELECT *, media IS NULL OR n < 10 AS suprimido FROM cells)
    SELECT c_custkey, n_name, ano, CASE WHEN NOT suprimido THEN round(media, 3) END AS valor, n, suprimido,
           CASE WHEN NOT suprimido THEN rank() OVER (PARTITION BY n_name, ano, suprimido ORDER BY media DESC) END AS posicao,
           CASE WHEN NOT suprimido THEN count(*) OVER (PARTITION BY n_name, ano, suprimido) END AS total
    FROM shown""")
def map_cells_state_year(spark, sf):
    """Mean and count by municipality and year, small cells suppressed, with the place in the state."""
    cells = city_year_cells(spark, sf).withColumn("suprimido", F.col("media").isNull() | (F.col("n") < 10))
    cells = cells.withColumn("media", F.when(~F.col("suprimido"), F.col("media")))
    out = windows.position_in_group(cells, ["n_name", "ano"], "media")
    return out.select("c_custkey", "n_name", "ano", r_product(F.col("media"), 3).alias("valor"), "n", "suprimido", F.col("posicao").cast("long").alias("posicao"), "total")


@query("""
    WITH g AS (SELECT o_custkey, year(o_orderdate) AS ano, count(*) AS n, avg(o_totalprice) AS media, max(o_totalprice) AS maior
               FROM orders GROUP BY ALL)
    SELECT o_custkey, ano, n, n < 3 AS suprimido, CASE WHEN n >= 3 THEN round(media, 3) END AS media,
           CASE WHEN n >= 3 THEN maior END AS maior, CASE WHEN n >= 3 THEN n END AS n_publicavel FROM g""")
def suppress_generic(spark, sf):
    g = t(spark, sf, "orders").groupBy("o_custkey", year("o_orderdate").alias("ano")).agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("media"), F.max("o_totalprice").alias("maior"))
    out = suppress.publishable_count(suppress.by_count(g, "n", ["media", "maior"], 3), "n")
    return out.withColumn("media", r("media", 3))


@query("""
    WITH g AS (SELECT o_custkey, count(*) AS n, nullif(count(*) FILTER (WHERE o_orderstatus = 'F'), 0) AS n_f,
                      count(*) FILTER (WHERE o_orderstatus = 'O') AS n_o,
                      avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS media_f,
                      avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS media_o
               FROM orders GROUP BY 1)
    SELECT o_custkey, n, n_f, n_o, n < 8 AS suprimido,
           CASE WHEN n >= 8 AND coalesce(n_f, 5) >= 5 THEN round(media_f, 3) END AS media_f,
           CASE WHEN n >= 8 AND coalesce(n_o, 0) >= 5 THEN round(media_o, 3) END AS media_o FROM g""")
def suppress_metric_bases(spark, sf):
    """Each metric against its own count; a null count keeps the metric, or hides it where asked."""
    count = lambda s: F.count(F.when(F.col("o_orderstatus") == s, 1))
    mean = lambda s: F.avg(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")))
    g = t(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.nullif(count("F"), F.lit(0)).alias("n_f"), count("O").alias("n_o"), mean("F").alias("media_f"), mean("O").alias("media_o"))
    g = suppress.by_own_base(g, {"media_f": "n_f"}, 5)
    g = suppress.by_own_base(g, {"media_o": "n_o"}, 5, null_base_hides=True)
    out = suppress.by_count(g, "n", ["media_f", "media_o"], 8)
    return out.withColumns({"media_f": r("media_f", 3), "media_o": r("media_o", 3)})


@query("""
    SELECT c_custkey AS codigo, c_acctbal < 0 OR n < 5 AS suprimido, n,
           CASE WHEN NOT (c_acctbal < 0 OR coalesce(n < 5, false)) THEN round(c_acctbal, 2) END AS valor
    FROM (SELECT c_custkey, c_acctbal, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL)""")
def suppress_serving_rule(spark, sf):
    c, o = t(spark, sf, "customer"), t(spark, sf, "orders")
    n = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    rows = c.join(n, c["c_custkey"] == n["o_custkey"], "left").withColumns({"n": F.coalesce("n", F.lit(0)), "v": F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))})
    return suppress.serving_cells(rows, "c_custkey", "v", "n", 5)


@query("""
    SELECT n_name, p_type AS grupo, sum(n)::BIGINT AS n, sum(n) < 40 AS suprimido, CASE WHEN sum(n) >= 40 THEN round(sum(v) / sum(n), 3) END AS media
    FROM (SELECT s_suppkey, s_nationkey, l_partkey, count(*) AS n, sum(l_extendedprice) AS v
          FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)
         JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey
    GROUP BY ALL""")
def resuppress_after_rollup(spark, sf):
    """Raw counts are summed to the larger place first; the threshold is applied to the sum."""
    li, s = t(spark, sf, "lineitem"), t(spark, sf, "supplier")
    base = li.join(s, li["l_suppkey"] == s["s_suppkey"]).groupBy("s_nationkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_extendedprice").alias("v"))
    rows = base.join(t(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    g = rows.groupBy("n_name", F.col("p_type").alias("grupo")).agg(F.sum("n").alias("n"), r(F.sum("v") / F.sum("n"), 3).alias("media"))
    return suppress.by_count(g, "n", ["media"], 40)


@query("""
    WITH g AS (SELECT o_custkey, count(*) AS n, avg(o_totalprice) FILTER (WHERE o_orderstatus = 'P') AS a, avg(o_totalprice) FILTER (WHERE o_orderpriority LIKE '5%' AND o_orderstatus = 'F') AS b FROM orders GROUP BY 1)
    SELECT count(*) AS n, count(*) FILTER (WHERE a IS NULL AND b IS NULL) AS suprimidos FROM g""")
def suppress_inherited(spark, sf):
    st = F.col("o_orderstatus")
    g = t(spark, sf, "orders").groupBy("o_custkey").agg(F.avg(F.when(st == "P", F.col("o_totalprice"))).alias("a"), F.avg(F.when(F.col("o_orderpriority").startswith("5") & (st == "F"), F.col("o_totalprice"))).alias("b"))
    return suppress.inherited(g, ["a", "b"]).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("suprimido"), 1)).alias("suprimidos"))


@query("""
    WITH g AS (SELECT o_custkey, count(*) AS n, avg(o_totalprice) AS v FROM orders GROUP BY 1)
    SELECT CASE WHEN n < 10 THEN '<10' ELSE n::VARCHAR END AS mostrado, count(*) AS lugares FROM g GROUP BY 1""")
def masked_counts(spark, sf):
    g = t(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy(suppress.masked_count(F.col("n")).alias("mostrado")).agg(F.count(F.lit(1)).alias("lugares"))


# ---------------------------------------------------------------- aggregates
@query("""
    SELECT n_name, count(o_orderkey) AS n, round(count(o_orderkey) / sum(DISTINCT pop) * 100000, 4) AS taxa_100k
    FROM (SELECT c_custkey, n_name, sum(abs(c_acctbal) + 1) OVER (PARTITION BY n_name) AS pop FROM customer JOIN nation ON c_nationkey = n_nationkey)
         LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P') ON o_custkey = c_custkey
    GROUP BY n_name""")
def rate_per_100k_zero_filled(spark, sf):
    c = t(spark, sf, "customer").join(t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).withColumn("pop", F.abs("c_acctbal") + 1)
    o = t(spark, sf, "orders").filter("o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return ag.rate_per_100k(c, o, "c_custkey", "n_name", "pop").withColumn("taxa_100k", r("taxa_100k"))


@query("""
    WITH d AS (SELECT n_name, r_name, s_acctbal AS v, cnt AS w FROM supplier
               JOIN (SELECT l_suppkey, count(*) AS cnt FROM lineitem GROUP BY 1) ON s_suppkey = l_suppkey
               JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
    SELECT 'estado' AS grao, n_name AS lugar, round(sum(v * w) / sum(w), 4) AS valor, sum(w)::BIGINT AS n FROM d WHERE v > 0 GROUP BY n_name
    UNION ALL
    SELECT 'regiao', r_name, round(sum(v * w) / sum(w), 4), sum(w)::BIGINT FROM d WHERE v > 0 GROUP BY r_name""")
def weighted_mean_two_grains(spark, sf):
    """Means weighted by rows at two grains, each from the base rows: a mean of means would weigh wrongly."""
    w = t(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("w"))
    d = t(spark, sf, "supplier").join(w, F.col("s_suppkey") == F.col("l_suppkey")).join(t(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    d = d.join(t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).withColumn("v", F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")))
    grain = lambda name, c: ag.ratio_means(d.filter("v IS NOT NULL"), [c], "v", "w").select(F.lit(name).alias("grao"), F.col(c).alias("lugar"), r("valor").alias("valor"), "n")
    return grain("estado", "n_name").unionByName(grain("regiao", "r_name"))


@query("""
    WITH s AS (SELECT l_returnflag AS k, CASE WHEN l_discount > 0.05 THEN l_discount END AS v, CASE WHEN l_tax > 0.02 THEN l_tax END AS v2, l_quantity AS w FROM lineitem)
    SELECT k, round(sum(v * w) FILTER (WHERE v IS NOT NULL) / sum(w) FILTER (WHERE v IS NOT NULL), 6) AS media_lp,
           round(sum(coalesce(v2, 0) * CASE WHEN v IS NOT NULL THEN w ELSE 0 END) / sum(CASE WHEN v IS NOT NULL THEN w ELSE 0 END), 6) AS media_mt
    FROM s GROUP BY k""")
def language_weight_on_mathematics(spark, sf):
    """The second mean under the first one's weights, with null as 0: the literal rule of the published tables."""
    li = t(spark, sf, "lineitem").select("l_returnflag", F.when(F.col("l_discount") > 0.05, F.col("l_discount")).alias("v"), F.when(F.col("l_tax") > 0.02, F.col("l_tax")).alias("v2"), "l_quantity")
    w = F.when(F.col("v").isNotNull(), F.col("l_quantity"))
    return li.groupBy(F.col("l_returnflag").alias("k")).agg(r(ag.weighted_mean(F.col("v"), F.col("l_quantity")), 6).alias("media_lp"), r(ag.weighted_mean_null_as_zero(F.col("v2"), w), 6).alias("media_mt"))


_BANDS = ", ".join(f"('{a}', {float(b)}::DOUBLE, {'NULL' if c is None else float(c)}::DOUBLE, {float(d)}::DOUBLE)" for a, b, c, d in config.INCOME_BANDS)


@query(f"""
    WITH fx(faixa, lim_inf, lim_sup, pm) AS (VALUES {_BANDS}),
    b AS (SELECT c_nationkey, c_mktsegment, (c_custkey % 7)::INT AS q005, chr((65 + c_custkey % 19)::INT) AS faixa FROM customer),
    v AS (SELECT b.*, lim_inf, lim_sup, pm, q005 BETWEEN 1 AND 20 AND pm IS NOT NULL AS ok FROM b LEFT JOIN fx USING (faixa))
    SELECT c_nationkey::BIGINT AS c_nationkey, count(*) AS n, count(*) FILTER (WHERE ok) AS n_valida,
           round(100.0 * avg(CASE WHEN pm / q005 <= 1.5 THEN 1.0 ELSE 0.0 END) FILTER (WHERE ok), 4) AS pct_medio,
           round(100.0 * avg(CASE WHEN lim_sup IS NOT NULL AND lim_sup / q005 <= 1.5 THEN 1.0 ELSE 0.0 END) FILTER (WHERE ok), 4) AS pct_certo,
           round(100.0 * avg(CASE WHEN lim_inf / q005 >= 1.5 THEN 1.0 ELSE 0.0 END) FILTER (WHERE ok), 4) AS pct_acima,
           round(median(pm / q005) FILTER (WHERE ok), 6) AS mediana
    FROM v GROUP BY 1""")
def income_band_profile(spark, sf):
    from .exam import bands

    b = t(spark, sf, "customer").select(F.col("c_nationkey").cast("long").alias("c_nationkey"), (F.col("c_custkey") % 7).cast("int").alias("q005"), F.char(65 + F.col("c_custkey") % 19).alias("letra"))
    v = b.join(bands(spark), F.col("letra") == F.col("faixa"), "left")
    ok = F.col("q005").between(1, 20) & F.col("pm").isNotNull()
    per = lambda c: domain.per_head(F.col(c), F.col("q005"))
    kind = domain.income_class(F.col("lim_inf"), F.col("lim_sup"), F.col("q005"))
    return v.groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(ok, 1)).alias("n_valida"), r(ag.percent(per("pm") <= 1.5, ok)).alias("pct_medio"),
        r(ag.percent(kind == "certamente_le", ok)).alias("pct_certo"), r(ag.percent(kind == "acima", ok)).alias("pct_acima"), r(F.median(F.when(ok, per("pm"))), 6).alias("mediana"),
    )


@query("""
    SELECT year(l_shipdate) AS ano, count(*) AS n, round(avg(l_extendedprice), 3) AS media, round(stddev_samp(l_extendedprice), 3) AS desvio,
           round(quantile_cont(l_extendedprice, 0.1), 4) AS p10, round(median(l_extendedprice), 4) AS p50, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90
    FROM lineitem GROUP BY 1""")
def score_distribution(spark, sf):
    p = F.percentile("l_extendedprice", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    g = t(spark, sf, "lineitem").groupBy(year("l_shipdate").alias("ano")).agg(F.count(F.lit(1)).alias("n"), r(F.avg("l_extendedprice"), 3).alias("media"), r(F.stddev_samp("l_extendedprice"), 3).alias("desvio"), p.alias("p"))
    return g.select("ano", "n", "media", "desvio", *[r(F.col("p")[i]).alias(c) for i, c in enumerate(("p10", "p50", "p90"))])


@query("""
    SELECT unnest(['status', 'prioridade', 'preco']) AS coluna, unnest([
      round(100 * avg((nullif(o_orderstatus, 'P') IS NULL)::INT), 4), round(100 * avg((nullif(o_orderpriority, '3-MEDIUM') IS NULL)::INT), 4),
      round(100 * avg((CASE WHEN o_totalprice > 1000 THEN 1 END IS NULL)::INT), 4)]) AS pct_nulo FROM orders""")
def null_rate_profile(spark, sf):
    d = t(spark, sf, "orders").select(
        F.nullif("o_orderstatus", F.lit("P")).alias("status"), F.nullif("o_orderpriority", F.lit("3-MEDIUM")).alias("prioridade"), F.when(F.col("o_totalprice") > 1000, F.col("o_totalprice")).alias("preco")
    )
    return ag.null_rates(d, d.columns).withColumn("pct_nulo", r("pct_nulo"))


@query("""
    SELECT o_orderpriority AS k, o_orderstatus AS s, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY o_orderpriority), 6) AS pct
    FROM orders GROUP BY o_orderpriority, o_orderstatus""")
def share_of_total(spark, sf):
    o = t(spark, sf, "orders").select(F.col("o_orderpriority").alias("k"), F.col("o_orderstatus").alias("s"))
    return ag.share_of_total(o, ["k", "s"], ["k"]).withColumn("pct", r("pct", 6))


@query("""
    SELECT o_custkey, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS n_ouro, count(*) FILTER (WHERE o_orderpriority = '2-HIGH') AS n_prata,
           count(*) FILTER (WHERE o_orderpriority = '3-MEDIUM') AS n_bronze, min(year(o_orderdate)) AS primeiro_ano, max(year(o_orderdate)) AS ultimo_ano,
           count(DISTINCT year(o_orderdate)) AS n_anos
    FROM orders GROUP BY 1""")
def medal_pivot_counts(spark, sf):
    o = t(spark, sf, "orders").withColumn("ano", year("o_orderdate"))
    won = ag.pivot_counts(o, ["o_custkey"], "o_orderpriority", {"1-URGENT": "n_ouro", "2-HIGH": "n_prata", "3-MEDIUM": "n_bronze"})
    span = o.groupBy("o_custkey").agg(F.min("ano").alias("primeiro_ano"), F.max("ano").alias("ultimo_ano"), F.countDistinct("ano").alias("n_anos"))
    return won.join(span, "o_custkey")


@query("""
    WITH g AS (SELECT c_nationkey, c_mktsegment, count(*) AS n, avg(c_acctbal) AS saldo, min(c_acctbal) AS menor FROM customer GROUP BY ALL),
    s AS (SELECT *, n < 11 AS suprimido FROM g)
    SELECT c_nationkey::BIGINT AS c_nationkey, c_mktsegment, suprimido, metrica, CASE WHEN suprimido THEN NULL ELSE round(valor, 3) END AS valor
    FROM (SELECT c_nationkey, c_mktsegment, suprimido, 'saldo' AS metrica, saldo AS valor FROM s UNION ALL SELECT c_nationkey, c_mktsegment, suprimido, 'menor', menor FROM s)""")
def long_metrics_melt(spark, sf):
    g = t(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("long").alias("c_nationkey"), "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.avg("c_acctbal").alias("saldo"), F.min("c_acctbal").alias("menor"))
    return ag.melt(suppress.by_count(g, "n", ["saldo", "menor"], 11), ["c_nationkey", "c_mktsegment"], ["saldo", "menor"]).withColumn("valor", r("valor", 3))


@query("""
    SELECT c_mktsegment, round(avg(c_acctbal) FILTER (WHERE c_nationkey = 1), 4) AS saldo_1, round(avg(c_acctbal) FILTER (WHERE c_nationkey = 2), 4) AS saldo_2 FROM customer GROUP BY 1""")
def wide_pivot(spark, sf):
    d = t(spark, sf, "customer").select("c_mktsegment", F.col("c_nationkey").cast("string").alias("k"), F.col("c_acctbal").alias("saldo"))
    out = ag.wide_metrics(d, ["c_mktsegment"], "k", ["1", "2"], ["saldo"])
    return out.withColumns({c: r(c) for c in ("saldo_1", "saldo_2")})


@query("""
    SELECT o_orderstatus AS k, count(*) AS n, round(sum(o_totalprice), 2) AS soma FROM orders GROUP BY 1
    UNION ALL SELECT 'total', count(*), round(sum(o_totalprice), 2) FROM orders""")
def grand_total_row(spark, sf):
    g = t(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("soma"))
    return ag.with_total(g, "k", ["n", "soma"]).withColumn("soma", r("soma", 2))


@query("""
    SELECT l_returnflag AS k,
           round(avg((l_discount + l_tax) / 2), 6) AS todas,
           round(avg(CASE WHEN d IS NULL AND x IS NULL THEN NULL ELSE (coalesce(d, 0) + coalesce(x, 0)) / ((d IS NOT NULL)::INT + (x IS NOT NULL)::INT) END), 6) AS conhecidas,
           count((d + x) / 2) AS n_todas
    FROM (SELECT *, CASE WHEN l_discount > 0 THEN l_discount END AS d, CASE WHEN l_tax > 0 THEN l_tax END AS x FROM lineitem) GROUP BY 1""")
def row_means(spark, sf):
    """The two row-wise means: null as soon as one part is, and of the known parts."""
    d, x = F.when(F.col("l_discount") > 0, F.col("l_discount")), F.when(F.col("l_tax") > 0, F.col("l_tax"))
    return t(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("k")).agg(
        r(F.avg(ag.mean_of_all(F.col("l_discount"), F.col("l_tax"))), 6).alias("todas"), r(F.avg(ag.mean_of_known(d, x)), 6).alias("conhecidas"), F.count(ag.mean_of_all(d, x)).alias("n_todas")
    )


@query("""
    SELECT l_returnflag AS k, count(*) FILTER (WHERE q > 0 AND q <= 45) AS n_valido, sum((q = 0)::INT + (z = 0)::INT)::BIGINT AS zeros
    FROM (SELECT l_returnflag, CASE WHEN l_linenumber = 3 THEN 0 ELSE l_quantity END AS q, CASE WHEN l_linenumber = 2 THEN NULL WHEN l_linenumber = 3 THEN 0 ELSE l_tax END AS z FROM lineitem) GROUP BY 1""")
def outlier_scores(spark, sf):
    """Scores outside the scale are null; the count of zeros skips rows with any null score."""
    n = F.col("l_linenumber")
    d = t(spark, sf, "lineitem").select("l_returnflag", F.when(n == 3, 0).otherwise(F.col("l_quantity")).alias("q"), F.when(n == 2, None).when(n == 3, 0).otherwise(F.col("l_tax")).alias("z"))
    return d.groupBy(F.col("l_returnflag").alias("k")).agg(F.count(domain.valid_score(F.col("q"), top=45)).alias("n_valido"), F.sum(domain.zero_count(F.col("q"), F.col("z"))).alias("zeros"))


@query("""
    SELECT o_orderpriority AS k, count(*) AS linhas, round(100 * avg((o_orderstatus <> 'P')::INT), 4) AS pct_situacao FROM orders GROUP BY 1""")
def coverage_by_key(spark, sf):
    d = t(spark, sf, "orders").select(F.col("o_orderpriority").alias("k"), F.nullif("o_orderstatus", F.lit("P")).alias("situacao"))
    return ag.coverage(d, ["k"], ["situacao"]).withColumn("pct_situacao", r("pct_situacao"))


# ---------------------------------------------------------------- windows
@query("""
    SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1""")
def latest_row_per_entity(spark, sf):
    return windows.latest_row(t(spark, sf, "orders"), ["o_custkey"], F.col("o_orderdate").desc(), F.col("o_orderkey")).select("o_custkey", "o_orderkey", "o_totalprice")


@query("""
    SELECT o_custkey, arg_max(CASE WHEN o_orderstatus <> 'O' THEN o_totalprice END, (o_orderdate, o_orderkey)) FILTER (WHERE o_orderstatus <> 'O') AS ultimo_preco,
           arg_min(CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END, (o_orderdate, o_orderkey)) FILTER (WHERE o_orderstatus <> 'F') AS primeira_prioridade
    FROM orders GROUP BY 1""")
def latest_nonnull_per_column(spark, sf):
    """Columns may come from different rows: each skips its own nulls."""
    order = F.struct("o_orderdate", "o_orderkey")
    price = F.when(F.col("o_orderstatus") != "O", F.col("o_totalprice"))
    prio = F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority"))
    return t(spark, sf, "orders").groupBy("o_custkey").agg(ag.last_known(price, order).alias("ultimo_preco"), ag.first_known(prio, order).alias("primeira_prioridade"))


@query("""
    WITH v AS (SELECT p_partkey, CASE WHEN p_size > 3 THEN p_size END AS s FROM part),
    k AS (SELECT p_partkey, s, rank() OVER (ORDER BY s) AS a, count(*) OVER (PARTITION BY s) AS c, count(*) OVER () AS n FROM v WHERE s IS NOT NULL)
    SELECT v.p_partkey, round((a + (c - 1) / 2.0) / n, 8) AS percentil FROM v LEFT JOIN k USING (p_partkey)""")
def percentile_rank_avg_ties(spark, sf):
    d = t(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") > 3, F.col("p_size")).alias("s"))
    return windows.global_rank(d, "s", "percentil", percent=True).select("p_partkey", r("percentil", 8).alias("percentil"))


@query("""
    SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER w) / (max(c_acctbal) OVER w - min(c_acctbal) OVER w), 8) AS nota
    FROM customer WINDOW w AS (PARTITION BY c_nationkey)""")
def minmax_norm(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", r(windows.min_max("c_acctbal", ["c_nationkey"]), 8).alias("nota"))


@query("""
    WITH q AS (SELECT c_nationkey, quantile_cont(c_acctbal, [0.2, 0.4, 0.6, 0.8]) AS cuts FROM customer WHERE c_acctbal > 0 GROUP BY 1)
    SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 1 + len(list_filter(cuts, lambda x: c_acctbal >= x)) END AS classe FROM customer JOIN q USING (c_nationkey)""")
def quantile_classes(spark, sf):
    d = t(spark, sf, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("v"))
    return windows.quantile_classes(d, ["c_nationkey"], "v").select("c_custkey", F.col("classe").cast("long").alias("classe"))


@query("""
    SELECT CASE WHEN p_size > 0 AND p_size <= 10 THEN 'pequeno' WHEN p_size > 10 AND p_size <= 30 THEN 'medio' WHEN p_size > 30 AND p_size <= 45 THEN 'grande' ELSE 'nan' END AS faixa,
           CASE WHEN s < 80 THEN '<80' WHEN s < 85 THEN '80-<85' WHEN s < 90 THEN '85-<90' WHEN s < 95 THEN '90-<95' WHEN s < 100 THEN '95-<100' ELSE '100' END AS nota, count(*) AS n
    FROM (SELECT p_size, 70 + p_partkey % 31 AS s FROM part) GROUP BY ALL""")
def size_bands(spark, sf):
    d = t(spark, sf, "part").select(
        windows.right_closed_bands(F.col("p_size"), [0, 10, 30, 45], ["pequeno", "medio", "grande"]).alias("faixa"), windows.score_bands(70 + F.col("p_partkey") % 31).alias("nota")
    )
    return d.groupBy("faixa", "nota").agg(F.count(F.lit(1)).alias("n"))


@query("""
    WITH g AS (SELECT o_orderstatus AS tipo, year(o_orderdate) AS recorte, o_custkey, round(sum(o_totalprice), 2) AS valor FROM orders GROUP BY ALL)
    SELECT *, rank() OVER (PARTITION BY tipo, recorte ORDER BY valor DESC) AS posicao FROM g""")
def competition_rank_by_slice(spark, sf):
    g = t(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("tipo"), year("o_orderdate").alias("recorte"), "o_custkey").agg(r(F.sum("o_totalprice"), 2).alias("valor"))
    return windows.competition_rank(g, ["tipo", "recorte"], "valor").withColumn("posicao", F.col("posicao").cast("long"))


@query("""
    SELECT s_suppkey, s_nationkey::BIGINT AS s_nationkey, rank() OVER (PARTITION BY s_nationkey, ok ORDER BY s_acctbal DESC) * CASE WHEN ok THEN 1 END AS posicao,
           count(*) OVER (PARTITION BY s_nationkey, ok) * CASE WHEN ok THEN 1 END AS total
    FROM (SELECT *, s_acctbal > 0 AS ok FROM supplier)""")
def position_in_state(spark, sf):
    d = t(spark, sf, "supplier").withColumn("suprimido", F.col("s_acctbal") <= 0)
    return windows.position_in_group(d, ["s_nationkey"], "s_acctbal").select("s_suppkey", F.col("s_nationkey").cast("long").alias("s_nationkey"), F.col("posicao").cast("long").alias("posicao"), "total")


@query("""
    WITH cut AS (SELECT p_brand, quantile_cont(p_retailprice, 0.9) AS c FROM part GROUP BY 1),
    m AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity = 50 AND l_discount = 0.1)
    SELECT p_partkey, m.l_partkey IS NOT NULL AS membro, p_retailprice >= c OR m.l_partkey IS NOT NULL AS destaque
    FROM part JOIN cut USING (p_brand) LEFT JOIN m ON p_partkey = m.l_partkey""")
def top_decile_or_member_flag(spark, sf):
    m = t(spark, sf, "lineitem").filter("l_quantity = 50 AND l_discount = 0.1").select(F.col("l_partkey").alias("p_partkey"))
    return windows.top_share_or_member(t(spark, sf, "part"), ["p_brand"], "p_retailprice", m, "p_partkey").select("p_partkey", "membro", "destaque")


@query("""
    SELECT l_suppkey, l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_extendedprice FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) <= 3""")
def topk_per_group(spark, sf):
    d = t(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_extendedprice")
    return windows.top_k(d, ["l_suppkey"], 3, F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber"))


@query("""
    SELECT o_orderkey, row_number() OVER w > 1 AS linha_duplicada, row_number() OVER w - 1 AS ocorrencia, count(*) OVER (PARTITION BY o_custkey, o_orderpriority) AS n_grupo,
           count(*) OVER (PARTITION BY o_custkey, o_orderpriority) > 1 AS ambiguo
    FROM orders WINDOW w AS (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey)""")
def duplicate_and_occurrence(spark, sf):
    same = ["o_custkey", "o_orderpriority"]
    d = windows.duplicate_flag(t(spark, sf, "orders").select("o_orderkey", *same), same, "o_orderkey")
    d = windows.occurrence_index(d, same, "o_orderkey").withColumn("ocorrencia", F.col("ocorrencia").cast("long"))
    return windows.ambiguous_flag(windows.group_size(d, same), same).drop(*same)


@query("""
    SELECT p_brand, p_partkey, round(p_retailprice - coalesce(second, 0), 4) AS margem FROM (
      SELECT p_brand, p_partkey, p_retailprice, lead(p_retailprice) OVER w AS second, row_number() OVER w AS rn FROM part
      WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey)) WHERE rn = 1""")
def runner_up_margin(spark, sf):
    return windows.runner_up_margin(t(spark, sf, "part"), ["p_brand"], "p_retailprice", "p_partkey").select("p_brand", "p_partkey", r("margem").alias("margem"))


@query("""
    WITH k AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY md5('42|' || p_partkey), p_partkey) AS k,
                      CASE p_brand WHEN 'Brand#11' THEN 20 WHEN 'Brand#12' THEN 20 WHEN 'Brand#13' THEN 5 ELSE 0 END AS w FROM part),
    s AS (SELECT *, row_number() OVER (ORDER BY p_brand DESC, md5('42|' || p_partkey), p_partkey) AS spare FROM k WHERE k > w AND p_brand IN ('Brand#12', 'Brand#13'))
    SELECT p_partkey, p_brand, p_name FROM k WHERE k <= w
    UNION ALL SELECT p_partkey, p_brand, p_name FROM s WHERE spare <= 60 - (SELECT count(*) FROM k WHERE k <= w)""")
def stratified_sample(spark, sf):
    return windows.stratified_sample(t(spark, sf, "part"), "p_brand", {"Brand#11": 20, "Brand#12": 20, "Brand#13": 5}, "p_partkey", total=60, prefer=("Brand#13", "Brand#12")).select("p_partkey", "p_brand", "p_name")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 15")
def top_n(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(15)


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_name, c_custkey LIMIT 10 OFFSET 20")
def page_of_rows(spark, sf):
    return windows.page(t(spark, sf, "customer").select("c_custkey", "c_name"), 3, 10, F.col("c_name"), F.col("c_custkey"))


# ---------------------------------------------------------------- joins and sets
@query("""
    WITH a AS (SELECT o_orderkey, o_orderstatus AS k1, CASE WHEN o_custkey % 3 > 0 THEN o_custkey % 3 END AS k2 FROM orders),
    b AS (SELECT k1, k2, count(*) AS n FROM a GROUP BY ALL)
    SELECT a.o_orderkey, a.k1, a.k2, b.n FROM a LEFT JOIN b ON a.k1 = b.k1 AND a.k2 IS NOT DISTINCT FROM b.k2""")
def null_safe_link_join(spark, sf):
    a = t(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("k1"), F.nullif(F.col("o_custkey") % 3, F.lit(0)).alias("k2"))
    b = a.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"))
    return joins.null_safe(a, b, ["k1", "k2"])


@query("""
    WITH a AS (SELECT c_nationkey AS k, round(avg(c_acctbal), 4) AS v, 'primeira' AS fonte FROM customer WHERE c_acctbal > 5000 AND c_nationkey < 20 GROUP BY 1),
    b AS (SELECT s_nationkey AS k, round(avg(s_acctbal), 4) AS v, 'segunda' AS fonte FROM supplier GROUP BY 1)
    SELECT * FROM a UNION ALL SELECT * FROM b WHERE k NOT IN (SELECT k FROM a)""")
def fallback_source_union(spark, sf):
    a = t(spark, sf, "customer").filter("c_acctbal > 5000 AND c_nationkey < 20").groupBy(F.col("c_nationkey").alias("k")).agg(r(F.avg("c_acctbal")).alias("v")).withColumn("fonte", F.lit("primeira"))
    b = t(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(r(F.avg("s_acctbal")).alias("v")).withColumn("fonte", F.lit("segunda"))
    return joins.fallback_union(a, b, ["k"])


@query("""
    SELECT coalesce(a.k, b.k) AS k, n, m FROM (SELECT c_custkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1) a
    FULL JOIN (SELECT o_custkey AS k, count(*) AS m FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) b ON a.k = b.k""")
def full_outer_merge(spark, sf):
    a = t(spark, sf, "customer").filter("c_acctbal > 0").groupBy(F.col("c_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    b = t(spark, sf, "orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("m"))
    return a.join(b, "k", "full")


@query("""
    SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey <> 3) GROUP BY 1""")
def fk_violations(spark, sf):
    d = t(spark, sf, "customer").filter("c_nationkey <> 3")
    return joins.violations(t(spark, sf, "orders"), "o_custkey", d, "c_custkey").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


@query("""
    WITH dim AS (SELECT c_nationkey AS k1, c_mktsegment AS k2, count(*) AS n, min(c_custkey) AS c FROM customer WHERE c_acctbal > 9000 GROUP BY ALL)
    SELECT c_custkey, CASE WHEN n = 1 THEN c END AS codigo, CASE WHEN n = 1 THEN 'exato' WHEN n > 1 THEN 'ambiguo' ELSE 'sem_match' END AS match
    FROM customer LEFT JOIN dim ON c_nationkey = k1 AND c_mktsegment = k2""")
def unique_key_match_class(spark, sf):
    c = t(spark, sf, "customer")
    dim = c.filter("c_acctbal > 9000").select("c_nationkey", "c_mktsegment", F.col("c_custkey").alias("codigo"))
    return joins.match_unique(c.select("c_custkey", "c_nationkey", "c_mktsegment"), dim, ["c_nationkey", "c_mktsegment"], "codigo").drop("c_nationkey", "c_mktsegment")


@query("""
    SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AS tem_premio FROM customer""")
def membership_flag(spark, sf):
    urgent = t(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'")
    return joins.membership(t(spark, sf, "customer").select("c_custkey"), "c_custkey", urgent, "o_custkey", "tem_premio")


@query("""
    SELECT 'pedidos' AS origem, o_orderkey AS id, o_totalprice AS valor, NULL::BIGINT AS linha FROM orders WHERE o_orderstatus = 'P'
    UNION ALL SELECT 'itens', l_orderkey, l_extendedprice, l_linenumber::BIGINT FROM lineitem WHERE l_quantity = 50""")
def stack_sources(spark, sf):
    a = t(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.lit("pedidos").alias("origem"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("valor"))
    b = t(spark, sf, "lineitem").filter("l_quantity = 50").select(F.lit("itens").alias("origem"), F.col("l_orderkey").alias("id"), F.col("l_extendedprice").alias("valor"), F.col("l_linenumber").cast("long").alias("linha"))
    return a.unionByName(b, allowMissingColumns=True)


# ---------------------------------------------------------------- text, codes, mappings
@query(r"""
    SELECT doc_id, trim(regexp_replace(regexp_replace(upper(strip_accents(replace(text, 'ß', 'ss'))), '[^A-Z0-9 ]+', ' ', 'g'), '\s+', ' ', 'g')) AS nome FROM documents""")
def name_normalize(spark, sf):
    return t(spark, sf, "documents").select("doc_id", text.base_text(F.col("text")).alias("nome"))


@query("""
    SELECT p_partkey, array_to_string(list_transform(string_split(upper(trim(p_name)), ' '), lambda x: CASE x WHEN 'SR' THEN 'SENHOR' WHEN 'PROF' THEN 'PROFESSOR' ELSE x END), ' ') AS nome
    FROM (SELECT p_partkey, 'prof ' || p_name || ' sr' AS p_name FROM part)""")
def token_expand(spark, sf):
    d = t(spark, sf, "part").select("p_partkey", F.concat(F.lit("prof "), F.col("p_name"), F.lit(" sr")).alias("p_name"))
    return d.select("p_partkey", text.expand_tokens(F.upper(F.trim("p_name")), {"SR": "SENHOR", "PROF": "PROFESSOR"}).alias("nome"))


@query(r"""
    SELECT p_partkey, regexp_replace(upper(trim(p_name)), '\b(DE|DA|DO|DAS|DOS|D)\b', ' ', 'g') AS cidade, codigo FROM (
      SELECT p_partkey, p_name, lpad(regexp_replace(split_part(p_partkey::VARCHAR || '.0', '.', 1), '\D', '', 'g'), 7, '0') AS codigo FROM part)""")
def code_pad(spark, sf):
    d = t(spark, sf, "part")
    return d.select("p_partkey", F.regexp_replace(F.upper(F.trim("p_name")), r"\b(DE|DA|DO|DAS|DOS|D)\b", " ").alias("cidade"), text.digits_code(F.concat(F.col("p_partkey").cast("string"), F.lit(".0")), 7).alias("codigo"))


@query(r"""
    WITH f AS (SELECT p_partkey, replace(translate(upper(p_name), 'ZJYKWH', 'SGICV'), 'LL', 'L') AS n FROM part)
    SELECT p_partkey, array_to_string(list_transform(range(1, len(n) + 1), lambda i: CASE WHEN i > 1 AND n[i] = n[i - 1] THEN '' ELSE n[i] END), '') AS dobrado FROM f""")
def phonetic_fold(spark, sf):
    return t(spark, sf, "part").select("p_partkey", text.phonetic_fold(F.upper("p_name")).alias("dobrado"))


@query("""
    SELECT p_partkey, 'ESCOLA MUNICIPAL ENSINO FUNDAMENTAL PROFESSORA ' || upper(p_name) || ' II' AS nome, upper(p_name) || ' II' AS nucleo, 'II' AS numeros FROM part""")
def name_core(spark, sf):
    """Letters joined and abbreviations written out, generic words dropped: the oracle has the rules' result for the fixed part."""
    d = t(spark, sf, "part").select("p_partkey", text.school_name(F.concat(F.lit("E M E F Profª "), F.col("p_name"), F.lit(" II"))).alias("nome"))
    return d.withColumns({"nucleo": text.name_core(F.col("nome")), "numeros": F.array_join(text.number_tokens(F.col("nome")), ",")})


@query("""
    SELECT CASE WHEN c IN ('F', 'E', 'M') THEN 'publica' WHEN c = 'P' THEN 'privada' ELSE 'desconhecida' END AS grupo,
           CASE c WHEN 'F' THEN 'federal' WHEN 'E' THEN 'estadual' WHEN 'M' THEN 'municipal' WHEN 'P' THEN 'privada' WHEN 'C' THEN 'outra' END AS detalhe, count(*) AS n
    FROM (SELECT substr('FEMPCX', (o_orderkey % 6 + 1)::INT, 1) AS c FROM orders) GROUP BY ALL""")
def network_map(spark, sf):
    d = t(spark, sf, "orders").select(F.substring(F.lit("FEMPCX"), (F.col("o_orderkey") % 6 + 1).cast("int"), F.lit(1)).alias("c"))
    return d.groupBy(domain.award_network(F.col("c")).alias("grupo"), domain.network(F.col("c"), "awards")[1].alias("detalhe")).agg(F.count(F.lit(1)).alias("n"))


@query("""
    WITH a AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'OBMEP' WHEN 1 THEN 'OBI' ELSE 'OCMAT' END AS o,
                      CASE o_orderkey % 5 WHEN 0 THEN 'Iniciação' WHEN 1 THEN 'CF-OBI Programação' WHEN 2 THEN 'Universitária' WHEN 3 THEN 'Programação' END AS m,
                      (o_custkey % 5)::VARCHAR AS l, year(o_orderdate) AS ano FROM orders),
    e AS (SELECT *, CASE WHEN o = 'OBMEP' THEN CASE WHEN l IN ('1', '2') THEN 'EF2' WHEN l = '3' THEN 'EM' END
                     WHEN o = 'OCMAT' THEN CASE WHEN l IN ('1', '2') THEN 'EF2' WHEN l IN ('3', '4') THEN 'EM' END
                     WHEN m = 'Universitária' THEN 'superior' WHEN m = 'Iniciação' THEN CASE WHEN l IN ('1', '2') THEN 'EF2' END
                     WHEN m LIKE '%Programação' THEN CASE WHEN l IN ('1', '2') THEN 'EF2_EM' END END AS etapa FROM a)
    SELECT etapa, coalesce(etapa IN ('EF2', 'EM', 'EF2_EM'), false) AS no_escopo, NOT coalesce(etapa IN ('EM', 'superior'), false) OR ano >= 1996 AS elegivel, count(*) AS n FROM e GROUP BY ALL""")
def stage_and_eligibility(spark, sf):
    k, k5 = F.col("o_orderkey") % 3, F.col("o_orderkey") % 5
    comp = F.when(k == 0, "OBMEP").when(k == 1, "OBI").otherwise("OCMAT")
    mod = F.when(k5 == 0, "Iniciação").when(k5 == 1, "CF-OBI Programação").when(k5 == 2, "Universitária").when(k5 == 3, "Programação")
    d = t(spark, sf, "orders").select(domain.stage(comp, mod, (F.col("o_custkey") % 5).cast("string")).alias("etapa"), F.year("o_orderdate").alias("ano"))
    upper = domain.is_upper_secondary(F.col("etapa"), F.lit("sem nome"))
    return d.groupBy("etapa", domain.in_scope(F.col("etapa")).alias("no_escopo"), domain.eligible(upper, F.col("ano"), 1997).alias("elegivel")).agg(F.count(F.lit(1)).alias("n"))


_SALT = "sal-de-teste-com-mais-de-trinta-e-dois"


@query(f"""
    SELECT c_custkey, sha256('{_SALT}|' || c_custkey || '|' || coalesce(CASE WHEN c_acctbal > 0 THEN c_mktsegment END, '')) AS hash FROM customer""")
def salted_hash_ids(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", domain.salted_hash(_SALT, F.col("c_custkey"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment"))).alias("hash"))


@query(f"""
    SELECT c_custkey, (SELECT array_to_string(list_transform(string_split(c_name, ' '), lambda x: upper(x[1])), '.') || '.') || '#' ||
           upper(substr(sha256('{_SALT}|' || c_name || '|' || c_custkey), 1, 6)) AS pseudonimo FROM customer""")
def pseudonyms(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", domain.pseudonym(_SALT, F.col("c_name"), F.col("c_custkey")).alias("pseudonimo"))


@query("SELECT c_custkey, substr(sha1('OCMAT|' || c_name || '|' || c_nationkey || '|2025'), 1, 16) AS id FROM customer")
def sha1_identity(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", domain.sha1_identity(F.lit("OCMAT"), F.col("c_name"), F.col("c_nationkey"), F.lit(2025)).alias("id"))


@query(r"""
    SELECT doc_id, regexp_full_match(lang, '[a-z]{2}') AS lingua_ok, regexp_full_match(source, 'src\d') AS fonte_ok FROM documents""")
def full_match_check(spark, sf):
    return t(spark, sf, "documents").select("doc_id", text.full_match(F.col("lang"), "[a-z]{2}").alias("lingua_ok"), text.full_match(F.col("source"), r"src\d").alias("fonte_ok"))


@query(r"""
    SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE round(o_totalprice, 1) END AS valor FROM orders""")
def published_numbers(spark, sf):
    """Decimal comma, asterisks and signs for no data."""
    raw = F.when(F.col("o_orderkey") % 4 == 0, "ND***").otherwise(F.concat(F.replace(F.format_string("%.1f", r("o_totalprice", 1)), F.lit("."), F.lit(",")), F.lit("*")))
    return t(spark, sf, "orders").select("o_orderkey", text.not_available_to_number(raw).alias("valor"))


# ---------------------------------------------------------------- linkage, star
@query()
def fuzzy_link(spark, sf):
    """Part names against those of their brand, with letters lost: the record linkage end to end."""
    p = t(spark, sf, "part")
    schools = p.select(F.col("p_partkey").cast("string").alias("co_entidade"), F.col("p_name").alias("no_escola"), F.col("p_brand").alias("co_municipio"), (F.col("p_size") % 2 == 0).alias("rede_publica"))
    keys = p.select(
        F.lit("X").alias("olimpiada"), text.school_name(F.regexp_replace("p_name", "[aeiou]([a-z])$", "$1")).alias("escola_norm"), F.when(F.col("p_size") > 1, F.col("p_brand")).alias("co_municipio"),
        F.lit("ZZ").alias("uf"), F.when(F.col("p_size") == 2, "publica").otherwise("desconhecida").alias("rede_grp"),
    ).distinct()
    return linkage.link(keys, schools)


@query()
def similarity_scores(spark, sf):
    p = t(spark, sf, "part").select("p_partkey", "p_name", F.lead("p_name").over(Window.partitionBy("p_brand").orderBy("p_partkey")).alias("outro")).filter("outro IS NOT NULL")
    return p.select("p_partkey", similarity.ratio_col("p_name", "outro").alias("razao"), similarity.token_sort_col("p_name", "outro").alias("ordenado"), similarity.token_set_col("p_name", "outro").alias("conjunto"))


@query()
def identity_keys(spark, sf):
    """Identities of award rows, with their totals."""
    o = t(spark, sf, "orders").join(t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    medal = F.element_at(F.array(*map(F.lit, config.MEDALS)), (F.col("o_orderkey") % 4 + 1).cast("int"))
    rows = o.select(
        F.col("o_orderkey").alias("row_id"), F.lit("OBMEP").alias("olimpiada"), F.year("o_orderdate").alias("ano"), F.lit(None).cast("string").alias("modalidade"),
        F.lit("1").alias("nivel"), medal.alias("medalha"), text.person_name(F.col("c_name")).alias("nome_norm"), text.school_name(F.col("c_mktsegment")).alias("escola_norm"),
        F.lpad(F.col("c_nationkey").cast("string"), 7, "0").alias("co_municipio"), F.lit("ZZ").alias("uf"), F.lit("desconhecida").alias("rede_grp"),
    )
    links = rows.select(*linkage.KEY).distinct().select("*", F.lit("revisao").alias("link_status"), F.lit(85.0).alias("link_score"), F.lit(None).cast("string").alias("co_entidade"), F.lit("empate").alias("motivo"))
    return linkage.enrich(rows, links)[1]


@query("""
    SELECT 'c_name' AS coluna, count(*) FILTER (WHERE c_name IS NULL) AS n_nulo, count(*) FILTER (WHERE NOT regexp_full_match(c_name, 'Customer#[0-9]+')) AS n_invalido, count(DISTINCT c_name) AS n_distinto FROM customer
    UNION ALL SELECT 'c_mktsegment', count(*) FILTER (WHERE c_mktsegment IS NULL), count(*) FILTER (WHERE NOT regexp_full_match(c_mktsegment, '[A-M]+')), count(DISTINCT c_mktsegment) FROM customer""")
def key_audit(spark, sf):
    return star.key_audit(t(spark, sf, "customer"), {"c_name": "Customer#[0-9]+", "c_mktsegment": "[A-M]+"})


@query("""
    SELECT o_custkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS o_orderstatus, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1""")
def duplicate_composite_keys(spark, sf):
    d = t(spark, sf, "orders").select("o_custkey", F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"))
    return star.duplicate_keys(d, ["o_custkey", "o_orderstatus"])


# ---------------------------------------------------------------- models
_FEATURES = """
    SELECT c_custkey, c_nationkey, c_acctbal, count(o_orderkey) AS medalhas, abs(c_acctbal) * 10 + 1000 AS populacao,
           avg(o_totalprice) AS ideb, max(o_totalprice) AS saeb
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL"""


def features(spark, sf) -> DataFrame:
    o = t(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("medalhas"), ag.exact_mean(F.col("o_totalprice")).alias("ideb"), F.max("o_totalprice").alias("saeb"))
    c = t(spark, sf, "customer")
    out = c.join(o, c["c_custkey"] == o["o_custkey"], "left").select("c_custkey", "c_nationkey", "c_acctbal", F.coalesce("medalhas", F.lit(0)).alias("medalhas"), (F.abs("c_acctbal") * 10 + 1000).alias("populacao"), "ideb", "saeb")
    return out


@query(f"""
    WITH f AS ({_FEATURES}), r AS (SELECT sum(medalhas) / sum(populacao) AS r0 FROM f)
    SELECT c_custkey, round((medalhas + 20000 * r0) / (populacao + 20000) * 100000, 4) AS taxa_suavizada FROM f, r""")
def shrunk_rate(spark, sf):
    return model.shrunk_rate(features(spark, sf), "medalhas", "populacao").select("c_custkey", r("taxa_suavizada").alias("taxa_suavizada"))


@query(f"""
    WITH f AS ({_FEATURES}), m AS (SELECT avg(c_acctbal) AS m FROM f)
    SELECT c_custkey, round((medalhas * c_acctbal + 30 * m) / (medalhas + 30), 6) AS valor_suavizado FROM f, m""")
def shrunk_mean(spark, sf):
    return model.shrunk_mean(features(spark, sf), "c_acctbal", "medalhas").select("c_custkey", r("valor_suavizado", 6).alias("valor_suavizado"))


_RANK = "(rank() OVER (PARTITION BY {c} IS NULL ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0) / count({c}) OVER ()"


@query(f"""
    WITH f AS ({_FEATURES}),
    p AS (SELECT c_custkey, {_RANK.format(c="medalhas")} AS talento, CASE WHEN ideb IS NOT NULL THEN ({_RANK.format(c="ideb")} + {_RANK.format(c="saeb")}) / 2 END AS qualidade,
                 1 - {_RANK.format(c="c_acctbal")} AS vulnerabilidade FROM f)
    SELECT c_custkey, round(CASE WHEN qualidade IS NOT NULL THEN 0.5 * talento + 0.2 * qualidade + 0.3 * vulnerabilidade END, 6) AS indice FROM p""")
def index_composite(spark, sf):
    parts = model.components(features(spark, sf), "medalhas", ["ideb", "saeb"], "c_acctbal")
    return model.composite_index(parts).select("c_custkey", r("indice", 6).alias("indice"))


_MINMAX = "({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ())"
_TOPS = (50, 100, 200)
_AVG_RANK = "rank() OVER (PARTITION BY {p} ORDER BY {c}) + (count(*) OVER (PARTITION BY {p}, {c}) - 1) / 2.0"


@query(f"""
    WITH f AS ({_FEATURES}),
    p AS (SELECT c_custkey, {_RANK.format(c="medalhas")} AS a, CASE WHEN ideb IS NOT NULL THEN ({_RANK.format(c="ideb")} + {_RANK.format(c="saeb")}) / 2 END AS b, 1 - {_RANK.format(c="c_acctbal")} AS c,
                 {_MINMAX.format(c="medalhas")} AS a2, ({_MINMAX.format(c="ideb")} + {_MINMAX.format(c="saeb")}) / 2 AS b2, 1 - {_MINMAX.format(c="c_acctbal")} AS c2 FROM f),
    s(cenario, w0, w1, w2) AS (VALUES {", ".join(f"('{n}', {a!r}::DOUBLE, {b!r}::DOUBLE, {c!r}::DOUBLE)" for n, a, b, c in model.scenarios())}),
    e AS (SELECT cenario, c_custkey, round(0.5 * a + 0.2 * b + 0.3 * c, 12) AS base, round((w0 * a + w1 * b + w2 * c) / (w0 + w1 + w2), 12) AS alt FROM p, s WHERE b IS NOT NULL
          UNION ALL SELECT 'minmax', c_custkey, round(0.5 * a + 0.2 * b + 0.3 * c, 12), round(0.5 * a2 + 0.2 * b2 + 0.3 * c2, 12) FROM p WHERE b IS NOT NULL),
    r AS (SELECT *, {_AVG_RANK.format(p="cenario", c="-base")} AS rb, {_AVG_RANK.format(p="cenario", c="-alt")} AS rc, row_number() OVER (PARTITION BY cenario ORDER BY base DESC, c_custkey) AS pb,
                 row_number() OVER (PARTITION BY cenario ORDER BY alt DESC, c_custkey) AS pc FROM e),
    t AS (SELECT *, {", ".join(f"{_AVG_RANK.format(p=f'cenario, pb <= {n}', c=c)} AS {c}{n}" for n in _TOPS for c in ("rb", "rc"))} FROM r)
    SELECT cenario, round(corr(rb, rc), 6) AS spearman_geral,
           {", ".join(f"count(*) FILTER (WHERE pb <= {n} AND pc <= {n}) / {n}.0::DOUBLE AS retencao_top{n}, round(corr(rb{n}, rc{n}) FILTER (WHERE pb <= {n}), 6) AS spearman_top{n}" for n in _TOPS)}
    FROM t GROUP BY cenario""")
def sensitivity_grid(spark, sf):
    """Weights 20 % up and down, each at zero, and min-max components; the top 50, 100 and 200."""
    f = features(spark, sf)
    parts, other = (model.components(f, "medalhas", ["ideb", "saeb"], "c_acctbal", how=how) for how in ("rank", "minmax"))
    out = model.sensitivity(parts, "c_custkey", tops=_TOPS, scaled=other)
    return out.withColumns({c: r(c, 6) for c in out.columns if c.startswith("spearman")})


@query(f"""
    WITH f AS (SELECT * FROM ({_FEATURES}) WHERE ideb IS NOT NULL),
    k AS (SELECT rank() OVER (ORDER BY medalhas) + (count(*) OVER (PARTITION BY medalhas) - 1) / 2.0 AS a, rank() OVER (ORDER BY saeb) + (count(*) OVER (PARTITION BY saeb) - 1) / 2.0 AS b FROM f)
    SELECT round(corr(a, b), 8) AS spearman, count(*) AS n FROM k""")
def spearman_ranks(spark, sf):
    return model.spearman(features(spark, sf).filter("ideb IS NOT NULL"), "medalhas", "saeb").withColumn("spearman", r("spearman", 8))


@query(f"""
    WITH x AS (SELECT c_mktsegment AS g, c_acctbal AS v, {_AVG_RANK.format(p="1", c="c_acctbal")} AS k FROM customer WHERE c_mktsegment IS NOT NULL AND c_acctbal IS NOT NULL),
    s AS (SELECT sum(q) AS s, sum(n)::DOUBLE AS n, count(*) AS k FROM (SELECT sum(k) ** 2 / count(*) AS q, count(*) AS n FROM x GROUP BY g)),
    t AS (SELECT sum(c ** 3 - c) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM x GROUP BY v)),
    h AS (SELECT (12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (n ** 3 - n)) AS h, k - 1 AS gl FROM s, t)
    SELECT round(h, 6) AS h, gl, CASE WHEN gl = 4 THEN round(exp(-h / 2) * (1 + h / 2), 6) END AS p FROM h""")
def kruskal_wallis(spark, sf):
    """Five groups, so that the chi-square tail with four degrees of freedom has a closed form."""
    out = model.kruskal_wallis(t(spark, sf, "customer"), "c_mktsegment", "c_acctbal")
    return out.withColumns({"h": r("h", 6), "p": r("p", 6)})


@query("""
    WITH cut AS (SELECT quantile_cont(c_acctbal, 0.9) AS c FROM customer),
    g AS (SELECT c_mktsegment, count(*) AS n, avg(c_acctbal) AS m, sum((c_acctbal >= c)::INT) AS top FROM customer, cut GROUP BY 1)
    SELECT c_mktsegment, n, round(m, 4) AS media, round(top / n, 6) AS parcela_topo, 1.0::DOUBLE AS completude, round((top / sum(top) OVER ()) / (n / sum(n) OVER ()), 6) AS razao_representacao FROM g""")
def bias_by_group(spark, sf):
    out = model.bias_table(t(spark, sf, "customer"), "c_mktsegment", "c_acctbal")
    return out.withColumns({"media": r("media"), "parcela_topo": r("parcela_topo", 6), "razao_representacao": r("razao_representacao", 6)})


@query("""
    WITH j AS (SELECT l.quality AS y, (d.n_chars > 1000)::INT AS p, 1 + d.doc_id % 3 AS w FROM labels l JOIN documents d USING (doc_id))
    SELECT count(*) AS n, round(sum(w) FILTER (WHERE p = 1 AND y = 1) / sum(w) FILTER (WHERE p = 1), 8) AS precisao,
           round(sum(w) FILTER (WHERE p = 1 AND y = 1) / sum(w) FILTER (WHERE y = 1), 8) AS cobertura FROM j""")
def precision_recall_weighted(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", (F.col("n_chars") > 1000).cast("int").alias("p"), (1 + F.col("doc_id") % 3).alias("w"))
    out = model.precision_recall(t(spark, sf, "labels").join(d, "doc_id"), "p", "quality", "w")
    return out.withColumns({"precisao": r("precisao", 8), "cobertura": r("cobertura", 8)})


@query("""
    SELECT n_nationkey::BIGINT AS k, round(sum(c_acctbal) FILTER (WHERE c_mktsegment = 'BUILDING') / count(*) FILTER (WHERE c_mktsegment = 'BUILDING'), 4) AS media_f,
           round(sum(c_acctbal) FILTER (WHERE c_mktsegment = 'MACHINERY') / count(*) FILTER (WHERE c_mktsegment = 'MACHINERY'), 4) AS media_m
    FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def sex_gap(spark, sf):
    c = t(spark, sf, "customer").withColumns({"sexo": F.when(F.col("c_mktsegment") == "BUILDING", "F").when(F.col("c_mktsegment") == "MACHINERY", "M"), "w": F.lit(1.0), "k": F.col("c_nationkey").cast("long")})
    return model.sex_gap(c, ["k"], "sexo", "c_acctbal", "w").select("k", r("media_f").alias("media_f"), r("media_m").alias("media_m"))


@query("""
    WITH v AS (SELECT o_custkey::VARCHAR AS entidade_id, 'municipio' AS tipo, o_orderstatus AS recorte, 'premios' AS metrica, count(*)::DOUBLE AS valor, count(*) AS n FROM orders GROUP BY ALL
               UNION ALL SELECT o_custkey::VARCHAR, 'municipio', o_orderstatus, 'total', round(sum(o_totalprice), 2), count(*) FROM orders GROUP BY ALL)
    SELECT *, rank() OVER (PARTITION BY tipo, recorte, metrica ORDER BY valor DESC) AS posicao FROM v WHERE n >= 5""")
def ranking_slices(spark, sf):
    """Rankings by type, slice and metric; small cells are left out before they are ranked."""
    o = t(spark, sf, "orders").groupBy(F.col("o_custkey").cast("string").alias("entidade_id"), F.col("o_orderstatus").alias("recorte"))
    both = o.agg(F.count(F.lit(1)).alias("n"), r(F.sum("o_totalprice"), 2).alias("total")).withColumn("tipo", F.lit("municipio"))
    part = lambda name, value: both.select("entidade_id", "tipo", "recorte", F.lit(name).alias("metrica"), value.alias("valor"), "n")
    return model.ranking_table([part("premios", F.col("n").cast("double")), part("total", F.col("total"))], 5).withColumn("posicao", F.col("posicao").cast("long"))


@query("""
    SELECT o_orderstatus, max(year(o_orderdate)) AS ultimo, list_sort(list(DISTINCT year(o_orderdate))) AS anos FROM orders GROUP BY 1""")
def reference_years(spark, sf):
    return model.reference_years(t(spark, sf, "orders").select("o_orderstatus", year("o_orderdate").alias("ano")), "o_orderstatus")


@query("""
    WITH l AS (SELECT o_orderstatus AS link_status, CASE o_orderkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 END AS c FROM orders WHERE o_orderkey % 10 = 0 AND o_orderstatus <> 'P'),
    p AS (SELECT link_status, count(c) AS rotulados, avg(c) AS precisao FROM l GROUP BY 1),
    s AS (SELECT o_orderstatus AS link_status, count(*) AS n_linhas FROM orders GROUP BY 1)
    SELECT link_status, n_linhas, rotulados, round(precisao, 8) AS precisao,
           round(sum(precisao * n_linhas) OVER () / sum(CASE WHEN precisao IS NOT NULL THEN n_linhas END) OVER (), 8) AS precisao_ponderada FROM s LEFT JOIN p USING (link_status)""")
def link_precision_by_stratum(spark, sf):
    """Right links in a labelled sample by status, and reweighted to the sizes of the strata; one stratum has no labels."""
    o = t(spark, sf, "orders").select(F.col("o_orderstatus").alias("link_status"), "o_orderkey")
    label = F.when(F.col("o_orderkey") % 3 == 0, "1").when(F.col("o_orderkey") % 3 == 1, " 0 ").otherwise(" ")
    sample = o.filter((F.col("o_orderkey") % 10 == 0) & (F.col("link_status") != "P")).select("link_status", label.alias("correto"))
    out = model.link_precision(sample, o.groupBy("link_status").agg(F.count(F.lit(1)).alias("n_linhas")))
    return out.withColumns({"precisao": r("precisao", 8), "precisao_ponderada": r("precisao_ponderada", 8)})


@query("""
    WITH c AS (SELECT c_custkey::VARCHAR AS codigo, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS valor, c_mktsegment AS grupo FROM customer),
    k AS (SELECT *, CASE WHEN valor IS NOT NULL THEN rank() OVER (ORDER BY valor DESC NULLS LAST) END AS posicao FROM c)
    SELECT codigo, valor, posicao FROM k WHERE grupo IN ('BUILDING', 'MACHINERY')""")
def group_filter_keeps_rank(spark, sf):
    c = t(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("codigo"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("valor"), F.col("c_mktsegment").alias("grupo"))
    out = serve.group_filter(c.drop("grupo"), c.select("codigo", "grupo"), ["BUILDING", "MACHINERY"])
    return out.withColumn("posicao", F.col("posicao").cast("long"))


@query(f"""
    WITH a AS (SELECT c_name AS nome, c_custkey::VARCHAR AS aluno_key, ['Ouro', 'Prata', 'Bronze', 'Menção Honrosa'][o_orderkey % 4 + 1] AS medalha, year(o_orderdate)::INT AS ano,
                      ['EM', 'EF2', 'superior'][o_orderkey % 3 + 1] AS etapa, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey)
    SELECT o_orderkey, medalha, ano, etapa, upper(c[1:1]) || '.' || '#' || upper(substr(sha256('{_SALT}|' || c || '|' || aluno_key), 1, 6)) AS pseudonimo
    FROM (SELECT *, nome AS c FROM a) WHERE medalha <> 'Menção Honrosa' AND (etapa NOT IN ('EM', 'superior') OR ano >= 1997)""")
def medalist_list(spark, sf):
    """Medalists that may still be shown, by pseudonym alone."""
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (F.col("o_orderkey") % n + 1).cast("int"))
    o = t(spark, sf, "orders").join(t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    awards = o.select("o_orderkey", F.col("c_name").alias("nome"), F.col("c_custkey").cast("string").alias("aluno_key"), pick(["Ouro", "Prata", "Bronze", "Menção Honrosa"], 4).alias("medalha"),
                      F.year("o_orderdate").alias("ano"), pick(["EM", "EF2", "superior"], 3).alias("etapa"), F.lit("sem nome").alias("escola"))
    return serve.medalists(awards, 1998, _SALT).drop("escola")


@query()
def kmeans_profile(spark, sf):
    cols = ["medalhas", "c_acctbal", "ideb"]
    rows, _ = model.kmeans(features(spark, sf), "c_custkey", cols, ks=(3, 4), restarts=2)
    return model.cluster_profile(rows, cols)


@query("""
    WITH f AS (SELECT p_partkey, p_size::DOUBLE AS x, p_retailprice AS y FROM part),
    c AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, count(*) AS n FROM f),
    e AS (SELECT p_partkey, a + b * x AS esperado, y - (a + b * x) AS res, n FROM f, c)
    SELECT p_partkey, round(esperado, 4) AS esperado, round(res / sqrt(sum(res * res) OVER () / (n - 2)), 4) AS residuo FROM e""")
def regression_residuals(spark, sf):
    d = t(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    out = model.regression(d, "p_partkey", "y", ["x"])[0]
    return out.select("p_partkey", r("esperado").alias("esperado"), r("residuo").alias("residuo"))


@query()
def award_count_regression(spark, sf):
    """Expected awards by a negative-binomial model with the population as exposure."""
    rows = features(spark, sf).withColumn("x", F.col("c_acctbal") / 1e4)
    return model.regression(rows, "c_custkey", "medalhas", ["x"], "populacao")[0]


# ---------------------------------------------------------------- serving, sources, streams
@query("""
    SELECT p_type AS tipo, p_partkey::VARCHAR AS codigo, p_name AS nome, 'ZZ' AS uf, CASE WHEN n LIKE 'blue%' THEN 0 WHEN n LIKE '% blue%' THEN 1 ELSE 2 END::BIGINT AS pontos
    FROM (SELECT *, lower(p_name) AS n FROM part) WHERE contains(n, 'blue')
    QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY pontos, n, p_name, p_partkey::VARCHAR) <= 5""")
def search_suggest(spark, sf):
    index = t(spark, sf, "part").select(F.col("p_type").alias("tipo"), F.col("p_partkey").cast("string").alias("codigo"), F.col("p_name").alias("nome"), F.lit("ZZ").alias("uf"))
    return serve.search(index, "blue").withColumn("pontos", F.col("pontos").cast("long"))


_INDEX = """
    SELECT 'uf' AS tipo, substr(n_name, 1, 2) AS codigo, n_name AS nome FROM nation
    UNION ALL SELECT 'municipio', c_custkey::VARCHAR, c_mktsegment || ' ' || c_name FROM customer
    UNION ALL SELECT 'escola', p_partkey::VARCHAR, p_name FROM part"""


def search_index(spark, sf) -> DataFrame:
    states = t(spark, sf, "nation").select(F.lit("uf").alias("tipo"), F.substring("n_name", 1, 2).alias("codigo"), F.col("n_name").alias("nome"), F.substring("n_name", 1, 2).alias("uf"))
    cities = t(spark, sf, "customer").select(F.lit("municipio").alias("tipo"), F.col("c_custkey").cast("string").alias("codigo"), F.concat_ws(" ", "c_mktsegment", "c_name").alias("nome"), F.lit("ZZ").alias("uf"))
    schools = t(spark, sf, "part").select(F.lit("escola").alias("tipo"), F.col("p_partkey").cast("string").alias("codigo"), F.col("p_name").alias("nome"), F.lit("ZZ").alias("uf"))
    return states.unionByName(cities).unionByName(schools)


@query(f"""
    WITH i AS (SELECT *, lower(nome) AS n FROM ({_INDEX})),
    h AS (SELECT *, CASE WHEN n LIKE 'in%' THEN 0 WHEN n LIKE '% in%' THEN 1 WHEN contains(n, 'in') THEN 2 WHEN tipo = 'uf' AND codigo = 'IN' THEN 0 END::BIGINT AS pontos FROM i)
    SELECT tipo, codigo, nome, pontos FROM h WHERE pontos IS NOT NULL
    QUALIFY tipo = 'uf' OR row_number() OVER (PARTITION BY tipo ORDER BY pontos, n, nome, codigo) <= 5""")
def search_state_and_name(spark, sf):
    """All states that match by code or name, five cities, five schools."""
    return serve.search(search_index(spark, sf), "IN").drop("uf").withColumn("pontos", F.col("pontos").cast("long"))


@query(f"""
    WITH h AS (SELECT *, CASE WHEN tipo = 'uf' THEN CASE WHEN nome LIKE '12%' THEN 0 WHEN nome LIKE '% 12%' THEN 1 WHEN contains(nome, '12') THEN 2 END WHEN codigo LIKE '12%' THEN 0 END::BIGINT AS pontos FROM ({_INDEX}))
    SELECT tipo, codigo, nome, pontos FROM h WHERE pontos IS NOT NULL QUALIFY tipo = 'uf' OR row_number() OVER (PARTITION BY tipo ORDER BY lower(nome), nome, codigo) <= 5""")
def search_by_code(spark, sf):
    return serve.search(search_index(spark, sf), "12").drop("uf").withColumn("pontos", F.col("pontos").cast("long"))


@query("""
    SELECT n_name, count(*) AS n FROM nation JOIN customer ON n_nationkey = c_nationkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal BETWEEN 0 AND 5000 GROUP BY 1""")
def value_set_filter(spark, sf):
    c = t(spark, sf, "customer").filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & F.col("c_acctbal").between(0, 5000))
    return c.join(t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


@query("""
    SELECT 'pedidos' AS prova, list_sort(list(DISTINCT o_orderstatus)) AS etapas, list_sort(list(DISTINCT year(o_orderdate)::VARCHAR)) AS anos, list_sort(list(DISTINCT o_orderpriority)) AS redes FROM orders""")
def catalog(spark, sf):
    o = t(spark, sf, "orders").select(F.lit("pedidos").alias("prova"), F.col("o_orderstatus").alias("etapa"), F.year("o_orderdate").cast("string").alias("ano"), F.col("o_orderpriority").alias("rede"))
    return serve.catalog(o)


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS dia, event_type, count(*) AS n FROM events GROUP BY ALL")
def audit_daily_counts(spark, sf):
    return audit.daily_counts(t(spark, sf, "events")).withColumn("dia", F.col("dia").cast("timestamp_ntz"))


@query("""
    WITH s AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events),
    k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM s)
    SELECT user_id, min(ts) AS inicio, max(ts) + INTERVAL 30 MINUTE AS fim, count(*) AS n FROM k GROUP BY user_id, no""")
def audit_sessions(spark, sf):
    return audit.sessions(t(spark, sf, "events")).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("inicio", "fim")})


@query()
def html_list_parse(spark, sf):
    """Links and text lines of raw pages."""
    p = t(spark, sf, "pages").select("page_id", "html")
    links = html_lists.anchors(p).groupBy("page_id").agg(F.count(F.lit(1)).alias("n_links"))
    lines = html_lists.text_lines(p).groupBy("page_id").agg(F.count(F.lit(1)).alias("n_linhas"), F.sum(F.length("linha")).alias("n_letras"))
    return p.select("page_id", F.regexp_count(F.lower("html"), F.lit(r"<tr[\s>]")).cast("long").alias("n_tr")).join(links, "page_id", "left").join(lines, "page_id", "left")
