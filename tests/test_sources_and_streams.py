import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from meridia.sources import html_lists, readers, sinks
from meridia.streaming import audit


def write(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))
    return f"file://{path}"


def test_delimited_and_years(spark, tmp_path):
    write(tmp_path / "2023/DADOS/A.csv", "NO;X\nSão João;1\n\"mal ; feito;2\n", "latin-1")
    df = readers.delimited(spark, f"file://{tmp_path}", pattern="A.csv")
    assert df.columns == ["NO", "X"] and "São João" in {r.NO for r in df.collect()} and {t for _, t in df.dtypes} == {"string"}
    want = {2023: ["A.csv"], 2024: ["A.csv", "B.csv"]}
    assert readers.available_years(spark, f"file://{tmp_path}", want) == {2023: ["A.csv"]} and readers.missing_years(spark, f"file://{tmp_path}", want) == [2024]


def test_json_tables(spark, tmp_path):
    pop = write(tmp_path / "p.json", json.dumps([{"D1C": "Código", "D3C": "Ano", "V": "Valor"}, {"D1C": "3550308", "D3C": "2022", "V": "100"}, {"D1C": "12", "D3C": "2022", "V": "..."}]))
    assert sorted(map(tuple, readers.population_series(spark, pop).collect())) == [("0000012", 2022, None), ("3550308", 2022, 100)]
    loc = write(tmp_path / "l.json", json.dumps([
        {"id": 3550308, "nome": "A", "microrregiao": {"mesorregiao": {"UF": {"sigla": "SP", "regiao": {"sigla": "SE"}}}}},
        {"id": 5101837, "nome": "B", "microrregiao": None, "regiao-imediata": {"regiao-intermediaria": {"UF": {"sigla": "MT", "regiao": {"sigla": "CO"}}}}},
    ]))
    from meridia.plans.schools import municipality_dimension

    series = readers.population_series(spark, pop)
    got = {r.co_municipio: (r.uf, r.regiao, r.populacao) for r in municipality_dimension(readers.localities(spark, loc), series, series).collect()}
    assert got == {"3550308": ("SP", "SE", 100), "5101837": ("MT", "CO", None)}


def test_wide_sheet_and_labels(spark, tmp_path):
    sheet = write(tmp_path / "s.csv", "nota\n" * 9 + "SG_UF;Unnamed: 1;CO\nSP;x;1\n")
    assert [tuple(r) for r in readers.wide_sheet(spark, sheet).filter("CO = '1'").collect()] == [("SP", "1")]
    lab = write(tmp_path / "lab.csv", "id,correto\n1,\n2,1\n")
    assert {r.id: r.correto for r in readers.labelled_sample(spark, lab).collect()} == {"1": "", "2": "1"}
    rows = spark.createDataFrame([(1, "VAR A", "1"), (2, "", "2"), (3, "VAR B", "1")], "i int, v string, c string")
    assert [r.v for r in readers.dictionary_categories(rows, "i", "v").orderBy("i").collect()] == ["VAR A", "VAR A", "VAR B"]


PAGE = """<h1>Premiados 2023</h1><table><tr><th>Nome</th><th>Escola</th><th>Tipo</th><th>Munic&iacute;pio</th><th>UF</th><th>Medalha/Men&ccedil;&atilde;o</th></tr>
<tr><td>Ana</td><td>E1</td><td>M</td><td>Lins</td><td>SP</td><td>Ouro</td></tr><tr><td>---</td><td>-</td></tr><tr><td></td><td>x</td></tr></table>
<table><tr><td>menu</td></tr><tr><td>x</td></tr></table><a href="/m/1.html">Um</a><a href="/m/1.html">Dois</a><p>Cidade de Origem</p><p>Lins - SP</p>"""
BOARD = "<table><tr>" + "".join(f"<td>{c}</td>" for c in ("<img src='ouro.png'>", "1", "500", "Bia", "E2", "Bauru", "SP")) + "</tr><tr>" + "".join(f"<td>{c}</td>" for c in ("HM", "2", "1", "Caio", "E3", "Bauru", "SP")) + "</tr></table>"


def test_html(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, BOARD), (3, None), (4, "<p>Não houve premiados</p>")], "page_id int, html string")
    got = html_lists.award_rows(pages).collect()
    assert [(r.page_id, r.nome, r.escola_nome, r.rede, r.municipio_nome, r.uf, r.medalha, r.posicao) for r in got] == [(1, "Ana", "E1", "M", "Lins", "SP", "Ouro", None)]
    board = html_lists.board_rows(pages).orderBy("linha").collect()
    assert [(r.medalha, r.nome, r.uf) for r in board] == [("Ouro", "Bia", "SP"), ("Menção Honrosa", "Caio", "SP")]
    assert [(r.url, r.titulo) for r in html_lists.anchors(pages, pattern="^/m/").collect()] == [("/m/1.html", "Dois")]
    assert {r.page_id: r.valor for r in html_lists.label_value(html_lists.text_lines(pages), "page_id", "Cidade de Origem").collect()} == {1: "Lins - SP"}
    assert [r.e for r in pages.orderBy("page_id").select(html_lists.legitimately_empty(F.col("html")).alias("e")).collect()][3] is True
    assert pages.filter("page_id = 1").select(html_lists.row_count(F.col("html")).alias("n")).first().n == 6
    years = spark.createDataFrame([("Premiados 2023", "lista 2023", 2020), ("x", "lista 2021", 2020), ("x", "y", 2020)], "a string, b string, c int")
    assert [r.y for r in years.select(html_lists.edition_year(F.col("a"), F.col("b"), F.col("c")).alias("y")).collect()] == [2023, 2021, 2020]
    with pytest.raises(Exception, match="conflicting"):
        spark.createDataFrame([("2023", "2022", 1)], "a string, b string, c int").select(html_lists.edition_year(F.col("a"), F.col("b"), F.col("c"))).collect()


def test_pdf_words(spark):
    heads = [("ESTUDANTE", 10), ("MUNICÍPIO", 110), ("ESCOLA", 210), ("NÍVEL", 310), ("PREMIAÇÃO", 410)]
    words = [("f", 1, x - 5.0, 5.0, x + 5.0, 7.0, w) for w, x in heads]
    for y, row in ((50, ("Ana", "Vitória", "Escola", "1", "OURO")), (80, ("Bia", "Serra", "Colégio", "2", "PRATA"))):
        words += [("f", 1, x - 5.0, float(y), x + 5.0, y + 2.0, w) for (_, x), w in zip(heads, row)]
    words += [("f", 1, 205.0, 54.0, 215.0, 56.0, "Azul"), ("f", 2, 5.0, 30.0, 15.0, 32.0, "Caio"), ("f", 2, 405.0, 30.0, 415.0, 32.0, "OURO")]
    df = spark.createDataFrame(words, "arquivo string, pagina int, xmin double, ymin double, xmax double, ymax double, palavra string")
    got = [(r.estudante, r.municipio, r.escola, r.nivel, r.premiacao) for r in html_lists.pdf_rows(df).orderBy("pagina", "y").collect()]
    assert got == [("Ana", "Vitória", "Escola Azul", "1", "OURO"), ("Bia", "Serra", "Colégio", "2", "PRATA"), ("Caio", None, None, None, "OURO")]
    fixed = html_lists.repair_edges(spark.createDataFrame([("Ana", "Neto Serra (Centro)")], "estudante string, municipio string")).first()
    assert (fixed.estudante, fixed.municipio) == ("Ana Neto", "Serra")


def test_city_codes(spark):
    cities = spark.createDataFrame([("1", "Lins", "SP"), ("2", "Serra", "ES"), ("3", "Serra", "SP"), ("4", "Vitória", "ES")], "co_municipio string, no_municipio string, uf string")
    rows = spark.createDataFrame([(1, "Serra", "SP"), (2, "Serra", None), (3, "Lins", None), (4, "Nada", None)], "i int, c string, u string")
    assert {r.i: r.co_municipio for r in html_lists.city_codes(rows, cities, "c", "u", "ES").collect()} == {1: "3", 2: "2", 3: "1", 4: None}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2023, "a", 1.5), (2024, "b", None)], "ano int, k string, v double")
    root = f"file://{tmp_path}"
    sinks.append_edition(df, f"{root}/e")
    sinks.append_edition(df.filter("ano = 2024").withColumn("v", F.lit(9.0)), f"{root}/e")
    assert {(r.ano, r.v) for r in spark.read.parquet(f"{root}/e").collect()} == {(2023, 1.5), (2024, 9.0)}
    assert sinks.markdown(df).splitlines()[2] == "| 2023 | a | 1.5 |"
    sample = spark.createDataFrame([(1, "")], "id int, correto string")
    assert sinks.labels_once(sample, f"{root}/l", "correto") and sinks.labels_once(sample, f"{root}/l", "correto")
    sinks.csv(spark.createDataFrame([(1, "1")], "id int, correto string"), f"{root}/l")
    assert not sinks.labels_once(sample, f"{root}/l", "correto")
    sinks.versioned({"t": df}, root, "v1")
    assert spark.read.parquet(f"{root}/v1/parquet/t").count() == 2
    sinks.parquet(df, f"{root}/s", sort=["k"])
    sinks.json_slices(df, f"{root}/j", ["ano"])
    assert spark.read.json(f"{root}/j").count() == 2


def test_stream_equals_batch(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(minutes=17 * i), i % 3, "abc"[i % 3]) for i in range(200)] + [(5, start + timedelta(minutes=85), 2, "c")]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id int, event_type string")
    path = f"file://{tmp_path}/events"
    df.repartition(3).write.parquet(path)
    stream = audit.read_events(spark, path, df.schema, 1)
    audit.drain_table(audit.daily_counts(stream), "daily", f"file://{tmp_path}/c1")
    assert sorted(map(tuple, spark.table("daily").collect())) == sorted(map(tuple, audit.daily_counts(df).collect()))
    audit.drain(audit.without_repeats(audit.read_events(spark, path, df.schema), ["event_id"]), f"file://{tmp_path}/out", f"file://{tmp_path}/c2")
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 200
    audit.drain(audit.without_repeats(audit.read_events(spark, path, df.schema), ["event_id"]), f"file://{tmp_path}/out", f"file://{tmp_path}/c2")
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 200
    assert audit.sessions(df).agg(F.sum("n")).first()[0] == 201
