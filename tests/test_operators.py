import pytest
from pyspark.sql import functions as F

from meridia import config
from meridia.functions import domain
from meridia.operators import aggregate as ag
from meridia.operators import joins, suppress, windows


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_three_suppression_policies(spark):
    df = spark.createDataFrame([("a", 5.0, 9), ("b", 5.0, None), ("c", None, 50)], "k string, v double, n int")
    served = {r.codigo: r.suprimido for r in suppress.serving_cells(df, "k", "v", "n", 10).collect()}
    assert served == {"a": True, "b": False, "c": True}
    counted = suppress.by_count(df, "n", ["v"], 10)
    assert {r.k: r.suprimido for r in counted.collect()} == {"a": True, "b": True, "c": False}
    assert suppress.violations(counted, ["v"]).count() == 0
    assert suppress.violations(df.withColumn("suprimido", F.lit(True)), ["v"]).count() == 2
    own = suppress.by_own_base(df, {"v": "n"}, 10)
    assert {r.k: r.v for r in own.collect()} == {"a": None, "b": 5.0, "c": None}
    hidden = suppress.by_own_base(df, {"v": "n"}, 10, null_base_hides=True)
    assert {r.k: r.v for r in hidden.collect()}["b"] is None
    assert config.Suppression(by_table={"x": 3}).n_min("x") == 3 and config.Suppression().n_min("y") == 10


def test_per_column_last_and_latest_row(spark):
    df = spark.createDataFrame([(1, 2023, 5.0, 4.8), (1, 2025, None, 5.1)], "k int, y int, a double, b double")
    got = df.groupBy("k").agg(ag.last_known(F.col("a"), F.col("y")).alias("a"), ag.last_known(F.col("b"), F.col("y")).alias("b"), ag.first_known(F.col("a"), F.col("y")).alias("f"))
    assert rows(got) == [(1, 5.0, 5.1, 5.0)]
    assert rows(windows.latest_row(df, ["k"], F.col("y").desc()).select("a", "b")) == [(None, 5.1)]


def test_zero_flags_and_means(spark):
    df = spark.createDataFrame([(0.0, 0.0, None, 300.0), (0.0, 1.0, 0.0, 5.0)], "a double, b double, c double, d double")
    assert df.select(domain.zero_count(*map(F.col, "abcd")).alias("z")).agg(F.sum("z")).first()[0] == 2
    means = df.select(ag.mean_of_all(F.col("a"), F.col("c")).alias("x"), ag.mean_of_known(F.col("c"), F.col("d")).alias("y")).collect()
    assert [tuple(m) for m in means] == [(None, 300.0), (0.0, 2.5)]


def test_language_weight_on_mathematics(spark):
    df = spark.createDataFrame([(250.0, None, 10), (260.0, 270.0, 10)], "lp double, mt double, w int")
    got = df.agg(ag.weighted_mean_null_as_zero(F.col("mt"), F.when(F.col("lp").isNotNull(), F.col("w"))), ag.weighted_mean(F.col("mt"), F.col("w"))).first()
    assert tuple(got) == (135.0, 270.0)


def test_percent_rank_and_bands(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1, 2, 2, 5, None])], "i int, v int")
    want = [0.25, 0.625, 0.625, 1.0, None]
    assert [r.p for r in windows.global_rank(df, "v", "p", percent=True).orderBy("i").collect()] == want
    assert [r.p for r in df.withColumn("g", F.lit(1)).select("i", windows.percent_rank("v", ["g"]).alias("p")).orderBy("i").collect()] == want
    assert [r.p for r in windows.global_rank(df, "v", "p", descending=True).orderBy("i").collect()] == [4.0, 2.5, 2.5, 1.0, None]
    assert [r.p for r in windows.global_min_max(df, "v", "p").orderBy("i").collect()] == [0.0, 0.25, 0.25, 1.0, None]
    sizes = spark.createDataFrame([(20000.0, 90.0), (20001.0, 99.9), (None, 100.0), (5.0, None)], "p double, s double")
    bands = sizes.select(windows.right_closed_bands(F.col("p"), [0, 20000, 50000], ["<=20k", "20-50k"]).alias("a"), windows.score_bands(F.col("s")).alias("b"))
    assert [tuple(r) for r in bands.collect()] == [("<=20k", "90-<95"), ("20-50k", "95-<100"), ("nan", "100"), ("<=20k", "nan")]


def test_quantile_classes_threshold_goes_up(spark):
    df = spark.createDataFrame([("g", float(v)) for v in range(11)] + [("g", None)], "k string, v double")
    got = {r.v: r.classe for r in windows.quantile_classes(df, ["k"], "v").collect()}
    assert got[2.0] == 2 and got[1.0] == 1 and got[10.0] == 5 and got[None] is None


def test_null_safe_join_and_preservation(spark):
    a = spark.createDataFrame([("x", None), ("y", "1"), (None, None)], "k string, c string")
    b = spark.createDataFrame([("x", None, 5), (None, None, 7)], "k string, c string, v int")
    out = joins.null_safe(a, b, ["k", "c"])
    assert rows(out) == sorted([("x", None, 5), ("y", "1", None), (None, None, 7)], key=str)
    joins.keeps_rows(a, out)
    with pytest.raises(AssertionError):
        joins.keeps_rows(a, out.union(out))


def test_match_fallback_membership_priority(spark):
    dim = spark.createDataFrame([("a", "1"), ("b", "2"), ("b", "3")], "k string, code string")
    left = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    assert rows(joins.match_unique(left, dim, ["k"], "code")) == [("a", "1", "exato"), ("b", None, "ambiguo"), ("c", None, "sem_match")]
    first, second = spark.createDataFrame([("a", 1)], "k string, v int"), spark.createDataFrame([("a", 2), ("b", 3)], "k string, v int")
    assert rows(joins.fallback_union(first, second, ["k"])) == [("a", 1), ("b", 3)]
    assert rows(joins.membership(left, "k", dim, "k", "m")) == [("a", True), ("b", True), ("c", False)]
    cand = spark.createDataFrame([("q", "7", 1), ("q", "8", 0), ("q", "9", 0), ("r", "5", 2)], "q string, code string, rule int")
    assert rows(joins.rule_priority(cand, ["q"], F.col("rule"), "code")) == [("q", "7"), ("r", "5")]
    assert joins.violations(left, "k", dim, "k").count() == 1


def test_melt_total_null_rates_zero_fill(spark):
    df = spark.createDataFrame([("a", False, 1.0, None), ("b", True, None, None)], "k string, suprimido boolean, x double, y double")
    assert len(ag.melt(df, ["k"], ["x", "y"]).collect()) == 3
    assert {r.coluna: r.pct_nulo for r in ag.null_rates(df, ["x", "y"]).collect()} == {"x": 50.0, "y": 100.0}
    g = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    assert {r.k: r.n for r in ag.with_total(g, "k", ["n"]).collect()}["total"] == 3
    dim = spark.createDataFrame([("a", "s", 100), ("b", "s", 300)], "c string, uf string, pop int")
    counts = spark.createDataFrame([("a", 2)], "c string, n int")
    assert rows(ag.rate_per_100k(dim, counts, "c", "uf", "pop")) == [("s", 2, 500.0)]


def test_stratified_sample_backfills(spark):
    df = spark.createDataFrame([(i, "a" if i < 3 else "b") for i in range(30)], "i int, s string")
    out = windows.stratified_sample(df, "s", {"a": 10, "b": 5}, "i", total=12, prefer=("b",))
    assert out.count() == 12 and out.filter("s = 'a'").count() == 3
    assert rows(out) == rows(windows.stratified_sample(df.repartition(3), "s", {"a": 10, "b": 5}, "i", total=12, prefer=("b",)))


def test_eligibility_stage_network(spark):
    df = spark.createDataFrame([("EM", 2024), ("EM", 2025), ("EF2", 2016)], "etapa string, ano int")
    got = [r.e for r in df.select(domain.eligible(domain.is_upper_secondary(F.col("etapa"), F.lit("X")), F.col("ano"), 2026).alias("e")).collect()]
    assert got == [False, True, True]
    st = spark.createDataFrame([("OBI", "CF-OBI Programação", "1"), ("OBI", "Universitária", None), ("OBMEP", None, "3"), ("OBI", None, "1")], "o string, m string, n string")
    assert [r.e for r in st.select(domain.stage(F.col("o"), F.col("m"), F.col("n")).alias("e")).collect()] == ["EF2_EM", "superior", "EM", None]
    mixed = spark.createDataFrame([("EF2_EM", "Etec X"), ("EF2_EM", "Escola Y")], "e string, s string")
    assert [r.u for r in mixed.select(domain.is_upper_secondary(F.col("e"), F.col("s")).alias("u")).collect()] == [True, False]
    net = spark.createDataFrame([(1, 3), (None, 2), (None, 1), (4, 2)], "d int, s int")
    assert [tuple(r) for r in net.select(*domain.exam_network(F.col("d"), F.col("s"))).collect()] == [("publica", "federal"), ("publica", None), (None, None), ("privada", "privada")]


def test_salt_must_be_long(spark):
    with pytest.raises(ValueError):
        domain.salted_hash("short", F.lit("x"))


def test_exact_mean_is_the_same_in_any_order(spark):
    """Means of equal amounts tie wherever their rows lie; other values have the plain mean."""
    values = [0.1, 0.2, 0.3]
    rows = [(g, v) for g in range(6) for v in (values[g % 3 :] + values[: g % 3])]
    assert (0.1 + 0.2) + 0.3 != (0.2 + 0.3) + 0.1
    df = spark.createDataFrame(rows, "g int, v double").coalesce(1)
    got = {r.m for r in df.groupBy("g").agg(ag.exact_mean(F.col("v")).alias("m")).collect()}
    assert got == {0.2}
    odd = [(1, 0.12345), (1, 2.0), (2, float("nan")), (2, 1.0), (3, float("inf")), (3, 1.0), (4, 1e300), (4, None), (5, None), (6, -0.5), (6, None), (6, 0.25)]
    got = {r.g: r.m for r in spark.createDataFrame(odd, "g int, v double").groupBy("g").agg(ag.exact_mean(F.col("v")).alias("m")).collect()}
    assert got[1] == (0.12345 + 2.0) / 2 and got[2] != got[2] and got[3] == float("inf") and got[4] == 1e300 and got[5] is None and got[6] == -0.125


def test_index_ties_customers_of_equal_means(spark, tmp_path):
    from meridia.plans import queries

    prices = [0.1, 0.2, 0.3]
    spark.createDataFrame([(i, 1, 5.0) for i in range(3)], "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    orders = [(i, v) for i in range(3) for v in prices[i:] + prices[:i]]
    spark.createDataFrame(orders, "o_custkey long, o_totalprice double").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    got = queries.index_composite(spark, str(tmp_path)).collect()
    assert len(got) == 3 and len({r.indice for r in got}) == 1


def test_cells_of_equal_means_share_their_place(spark, tmp_path):
    from datetime import datetime

    from meridia.plans import queries

    prices = [176.12, 746.07, 82.72, 334.33, 154.56, 649.38, 997.41, 589.16, 618.99, 854.06, 497.57, 275.2]
    at = datetime(1997, 5, 5)
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    write([(1, "A")], "n_nationkey int, n_name string", "nation")
    write([(i, 1) for i in range(3)], "c_custkey long, c_nationkey int", "customer")
    write([(i, i, at) for i in range(3)], "o_orderkey long, o_custkey long, o_orderdate timestamp", "orders")
    write([(i, v, 0.1) for i in range(3) for v in prices[i:] + prices[:i]], "l_orderkey long, l_extendedprice double, l_discount double", "lineitem")
    got = queries.map_cells_state_year(spark, str(tmp_path)).collect()
    assert [(r.posicao, r.total, r.n, r.valor) for r in got] == [(1, 3, 12, 497.964)] * 3


def test_cells_round_halves_as_their_sql(spark, tmp_path):
    from datetime import datetime

    import duckdb

    from meridia.plans import queries

    at = datetime(1997, 5, 5)
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    write([(1, "A")], "n_nationkey int, n_name string", "nation")
    write([(1, 1), (2, 1)], "c_custkey long, c_nationkey int", "customer")
    write([(1, 1, at), (2, 2, at)], "o_orderkey long, o_custkey long, o_orderdate timestamp", "orders")
    prices = [(1, [33268.69] * 8 + [33268.72] + [33268.69] * 3), (2, [100.0] * 11 + [100.03])]  # means 33268.6925 and 100.0025
    write([(i, v, 0.1) for i, some in prices for v in some], "l_orderkey long, l_extendedprice double, l_discount double", "lineitem")
    con = duckdb.connect()
    for name in ("nation", "customer", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = {row[0]: row[3] for row in con.execute(queries.ORACLE_SQL["map_cells_state_year"]).fetchall()}
    got = {row.c_custkey: row.valor for row in queries.map_cells_state_year(spark, str(tmp_path)).collect()}
    assert got == want == {1: 33268.692, 2: 100.003}
