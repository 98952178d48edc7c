import numpy as np
import pytest
from pyspark.sql import functions as F

from meridia.config import LinkRules
from meridia.functions import stats
from meridia.plans import awards, exam, linkage, model, schools, serve, star

SALT = "a-salt-of-more-than-thirty-two-letters"
CITIES = [("3550308", "São Paulo", "SP", 1000), ("3500001", "Brazópolis", "MG", 500), ("3500002", "Itapajé", "CE", 300), ("3500003", "Bom Jesus", "SC", 10), ("3500004", "Bom Jesus", "SC", 20)]
SCHOOLS = [
    ("00000001", "EMEF Parque X", "3550308", True), ("00000002", "EMEF Parque X II", "3550308", True), ("00000003", "Colégio Santa Luzia", "3550308", False),
    ("00000004", "Escola Estadual Machado de Assis", "3550308", True), ("00000005", "CEF 24 de Sobradinho", "3500001", True), ("00000006", "CEF 28 de Sobradinho", "3500001", True),
]


@pytest.fixture(scope="module")
def cities(spark):
    return spark.createDataFrame(CITIES, "co_municipio string, no_municipio string, uf string, populacao long").cache()


@pytest.fixture(scope="module")
def school_dim(spark):
    return spark.createDataFrame(SCHOOLS, "co_entidade string, no_escola string, co_municipio string, rede_publica boolean").cache()


def test_attach_city(spark, cities):
    df = spark.createDataFrame([(1, "SAO PAULO", "sp"), (2, "Brasopolis", "MG"), (3, "Bom Jesus", "SC"), (4, "Nowhere", "SP"), (5, None, None)], "i int, m string, u string")
    got = {r.i: (r.co_municipio, r.match_municipio) for r in linkage.attach_city(df, cities, "m", "u").collect()}
    assert got == {1: ("3550308", "exato"), 2: ("3500001", "fuzzy"), 3: (None, "ambiguo"), 4: (None, "sem_match"), 5: (None, "sem_match")}


def link(spark, dim, rows):
    keys = spark.createDataFrame([("OBMEP", *r) for r in rows], "olimpiada string, escola_norm string, co_municipio string, uf string, rede_grp string")
    return {r.escola_norm: r for r in linkage.link(keys, dim).collect()}


def test_link_decisions(spark, school_dim):
    sp = lambda n, g="desconhecida": (n, "3550308", "SP", g)
    got = link(spark, school_dim, [
        sp("ESCOLA MUNICIPAL ENSINO FUNDAMENTAL PARQUE X"), sp("ESCOLA ESTADUAL MACHADO DE ASSIS"), sp("ESCOLA MUNICIPAL MACHADO DE ASSIS"), sp("ZZZZ QQQQ"), sp(""),
        ("QUALQUER", None, "SP", "publica"), ("OUTRA", "9999999", "SP", "publica"), ("COLEGIO SANTA LUZIA", "3550308", "SP", "publica"),
        ("CENTRO ENSINO FUNDAMENTAL 26 SOBRADINHO", "3500001", "MG", "publica"),
    ])
    one = got["ESCOLA MUNICIPAL ENSINO FUNDAMENTAL PARQUE X"]
    assert (one.link_status, one.co_entidade, one.link_score) == ("auto", "00000001", 100.0)  # PARQUE X II is capped by its number
    assert one.cand2_co_entidade == "00000002" and one.cand2_score == 89.9
    assert got["ESCOLA ESTADUAL MACHADO DE ASSIS"].co_entidade == "00000004"
    clash = got["ESCOLA MUNICIPAL MACHADO DE ASSIS"]
    assert clash.link_status == "revisao" and clash.co_entidade == "00000004"
    assert (got["ZZZZ QQQQ"].link_status, got["ZZZZ QQQQ"].motivo, got["ZZZZ QQQQ"].co_entidade) == ("sem_match", "score_baixo", None)
    assert got[""].motivo == "nome_vazio" and got["QUALQUER"].motivo == "sem_municipio" and got["OUTRA"].motivo == "sem_candidato_no_municipio"
    assert got["COLEGIO SANTA LUZIA"].link_status != "auto"  # a private school is no candidate of a public award
    assert got["CENTRO ENSINO FUNDAMENTAL 26 SOBRADINHO"].link_status == "revisao"


def test_tie_is_reviewed(spark):
    dim = spark.createDataFrame([("1", "Escola Bela Vista", "c", True), ("2", "Escola Bela Vista", "c", True)], "co_entidade string, no_escola string, co_municipio string, rede_publica boolean")
    r = link(spark, dim, [("ESCOLA BELA VISTA", "c", "SP", "publica")])["ESCOLA BELA VISTA"]
    assert (r.link_status, r.motivo, r.n_candidatos_mun) == ("revisao", "empate", 2)
    assert LinkRules().auto == 90


def award_rows(spark):
    rows = [
        ("OBMEP", 2024, "3", None, "Ouro", "Ana da Silva", "Escola Estadual Machado de Assis", "E", "São Paulo", "SP"),
        ("OBMEP", 2025, "3", None, "Prata", "ANA SILVA", "EE Machado de Assis", "E", "São Paulo", "SP"),
        ("OBMEP", 2025, "3", None, "Prata", "ANA SILVA", "EE Machado de Assis", "E", "São Paulo", "SP"),
        ("OBI", 2025, "1", "Programação", "Bronze", "Bruno", "Outra", None, "São Paulo", "SP"),
        ("OBI", 2025, "1", "Programação", "Menção Honrosa", "Caio", "Outra", None, None, None),
    ]
    df = spark.createDataFrame(rows, "olimpiada string, ano int, nivel string, modalidade string, medalha string, nome string, escola_nome string, rede string, municipio_nome string, uf string")
    return awards.stack(df)


def test_awards_to_star(spark, cities, school_dim):
    numbered = linkage.with_row_ids(award_rows(spark), "olimpiada", "ano", "nome")
    assert sorted(r.row_id for r in numbered.collect()) == list(range(5))
    ready = linkage.prepare_awards(numbered, cities).cache()
    links = linkage.link_table(ready, school_dim).cache()
    assert links.agg(F.sum("n_linhas")).first()[0] == 5
    assert linkage.review_queue(links, cities).columns[-1] == "decisao_manual"
    rates = linkage.link_rates(ready, links, ["olimpiada"])
    assert {r.olimpiada: (r.linhas, r.pct_sem_municipio) for r in rates.collect()} == {"OBMEP": (3, 0.0), "OBI": (2, 50.0)}
    rows, people = linkage.enrich(ready, links)
    ana = people.filter("nome_norm = 'ANA SILVA'").collect()
    assert len(ana) == 1 and (ana[0].n_premios, ana[0].n_medalhas, ana[0].n_anos, ana[0].co_entidade) == (2, 2, 2, "00000004")
    assert rows.filter("linha_duplicada").count() == 1 and rows.count() == 5
    fact = star.award_fact(rows, SALT).cache()
    assert star.duplicate_keys(fact, ["medalha_hash"]).count() == 0
    dim = star.person_dimension(people, SALT)
    assert star.name_leaks(fact, people).count() == 0 and star.name_leaks(dim, people).count() == 0
    with pytest.raises(ValueError):
        star.name_leaks(people, people)
    leak = star.name_leaks(people.select(F.col("nome_norm").alias("x")), people)
    assert leak.count() == people.count()
    report = star.contract_report({"fato_medalhas": fact, "dim_aluno": dim}, [("fato_medalhas", "aluno_hash", "dim_aluno", "aluno_hash")])
    assert {r.n for r in report.collect()} == {0}
    assert linkage.homonyms(rows, people).count() == 0
    cells = awards.medal_cells(rows.withColumn("co_municipio", F.col("co_municipio")), n_min=2)
    got = {(r.olimpiada, r.medalha): (r.n, r.n_publicavel, r.etapa, r.rede_grupo) for r in cells.collect()}
    assert got[("OBMEP", "Prata")] == (2, 2, "EM", "publica") and got[("OBI", "Bronze")] == (1, None, "EF2_EM", "desconhecida")
    mapped = serve.medal_map_cells(cells, cities)
    obi = {(r.etapa, r.codigo): r.n for r in mapped.filter("prova = 'obi' AND ano = 'todos' AND nivel = 'municipio'").collect()}
    assert obi[("EF2", "3550308")] == obi[("EM", "3550308")] == 1 and obi[("EM", "3500001")] == 0
    sums = mapped.filter("nivel = 'municipio'").groupBy("prova", "etapa", "ano", "uf").agg(F.sum("n").alias("a")).join(mapped.filter("nivel = 'uf'"), ["prova", "etapa", "ano", "uf"])
    assert sums.filter("a <> n").count() == 0 and sums.count() > 0
    assert awards.gaps(award_rows(spark), [2024, 2025], ["OBI", "OBMEP"]).collect()[0].asDict() == {"olimpiada": "OBI", "ano": 2024}


def exam_raw(spark):
    base = dict(CO_MUNICIPIO_ESC=" 3550308 ", CO_MUNICIPIO_PROVA="3550308", SG_UF_PROVA="SP", TP_DEPENDENCIA_ADM_ESC="2", NU_NOTA_CN="500.5", NU_NOTA_CH="0", NU_NOTA_LC="1200", NU_NOTA_MT="", NU_NOTA_REDACAO="0", TP_SEXO="F", TP_ST_CONCLUSAO="2", Q005="4", Q006="C", TP_ESCOLA="2")
    rows = [base] * 11 + [base | {"TP_ST_CONCLUSAO": "3"}, base | {"Q005": "0", "TP_SEXO": "M"}, base | {"Q006": "Z"}, base | {"CO_MUNICIPIO_PROVA": " "}]
    return spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{c} string" for c in base))


def test_exam(spark):
    got = exam.conform(exam_raw(spark), exam.source(2023, "microdados"))
    assert [f"{n}:{t}" for n, t in got.dtypes] == [f"{n}:{t}" for n, t in exam.COLUMNS.items()]
    r = got.first()
    assert (r.co_municipio_esc, r.nu_nota_mt, r.q005, r.co_escola, r.renda_familiar_faixa, r.co_escola_mascarado) == ("3550308", None, 4, None, "C", None)
    later = exam.conform(spark.createDataFrame([("61234567", "B", "x")], "CO_ESCOLA string, Q007 string, Q006 string"), exam.source(2024, "resultados")).first()
    assert later.co_escola_mascarado and later.renda_familiar_faixa == "B" and later.q006 == "x"
    table = exam.municipal(got).cache()
    p = table.filter("visao = 'perfil_prova'").first()
    assert (p.n, p.n_inscritos_total, p.n_renda_valida, p.n_masculino) == (13, 14, 11, 1)
    assert p.pct_certamente_le_1_5 == 100.0 and p.mediana_renda_pc_sm == pytest.approx(1.25 / 4) and p.mediana_renda_pc_reais == pytest.approx(1.25 / 4 * 1320)
    s = table.filter("visao = 'desempenho_prova' AND rede_grupo = 'publica'").first()
    assert (s.n, s.n_cn, s.n_ch, s.n_lc, s.media_cn, s.media_ch, s.pct_redacao_zero, s.suprimido) == (13, 13, 0, 0, 500.5, None, 100.0, False)
    assert s.n_nota_zero_invalidada is None  # a null score makes the count of zeros null
    small = exam.municipal(got, n_min=100)
    assert small.filter("NOT suprimido").count() == 0 and small.filter("media_cn IS NOT NULL OR pct_acima_1_5 IS NOT NULL").count() == 0


def test_schools(spark):
    raw = spark.createDataFrame(
        [("1", "355", "35", "1", "1", "250", "", "10", "12", "3", "0", "", "0"), ("2", "355", "35", "0", "2", "", "270", "", "", "", "", "", ""), ("3", "1", "99", "1", "1", "1", "1", "1", "1", "1", "1", "1", "1")],
        "ID_ESCOLA string, ID_MUNICIPIO string, ID_UF string, IN_PUBLICA string, ID_LOCALIZACAO string, MEDIA_9EF_LP string, MEDIA_9EF_MT string, NU_PRESENTES_9EF string, NU_MATRICULADOS_CENSO_9EF string, MEDIA_3EM_LP string, MEDIA_3EM_MT string, NU_PRESENTES_3EM string, NIVEL_SOCIO_ECONOMICO string",
    )
    students = spark.createDataFrame([("EF2", "1", "5.0", "1"), ("EF2", "1", "7.0", "1"), ("EF2", "1", "9.0", "0")], "etapa string, ID_ESCOLA string, INSE_ALUNO string, IN_INSE string")
    got = {(r.id_escola_saeb, r.etapa): r for r in schools.assessment(raw, 2019, students).collect()}
    assert set(got) == {("00000001", "EF2"), ("00000001", "EM")}
    one = got[("00000001", "EF2")]
    assert (one.uf, one.rede, one.localizacao, one.n_alunos, one.inse_aluno_medio, one.n_alunos_inse) == ("SP", "publica", "urbana", 10, 6.0, 2)
    df = spark.createDataFrame([("SP", "EF2", 2019, "publica", 250.0, None, 10, None, None), ("SP", "EF2", 2019, "publica", 260.0, 270.0, 10, 5.0, 2), (None, "EF2", 2019, "publica", 1.0, 1.0, 1, 1.0, 1)], "uf string, etapa string, ano int, rede string, proficiencia_lp double, proficiencia_mt double, n_alunos int, inse_aluno_medio double, n_alunos_inse int")
    s = schools.state_proficiency(df).collect()
    assert len(s) == 1 and (s[0].proficiencia_lp_media, s[0].proficiencia_mt_media, s[0].n) == (255.0, 135.0, 20)
    sheet = spark.createDataFrame([("SP", "3550308", "São Paulo", "Pública", "5,4*", "-", "98.1", "ND***", "x?"), ("Fonte: nota", None, None, None, None, None, None, None, None)], "SG_UF string, CO_MUNICIPIO string, NO_MUNICIPIO string, REDE string, VL_OBSERVADO_2023 string, VL_NOTA_MEDIA_2023 string, VL_APROVACAO_2023_SI_4 string, VL_OBSERVADO_2021 string, VL_NOTA_MEDIA_2021 string")
    table = schools.index_table(sheet, "EF2", school=False).collect()
    assert len(table) == 1 and (table[0].ano, table[0].ideb, table[0].taxa_aprovacao, table[0].nota_saeb_padronizada) == (2023, 5.4, 98.1, None)
    odd = {r.ocorrencia: r["count"] for r in schools.index_oddities(schools.index_long(sheet, ["SG_UF"])).collect()}
    assert odd == {"com_asterisco": 1, "nao_numerico:x?": 1}
    prof = schools.proficiency(schools.index_table(sheet, "EF2", school=False)).first()
    assert (prof.rede_grupo, prof.suprimido, prof.n) == ("publica", False, None)


def test_nb2_and_ols_and_indices():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((800, 2))
    y = 3 + x @ [2.0, -1.0] + rng.standard_normal(800) * 0.5
    fit = stats.ols(x, y)
    assert np.allclose(fit["beta"], [3, 2, -1], atol=0.1) and (fit["p"] < 1e-6).all()
    e = rng.uniform(50, 500, 800)
    mu = e * np.exp(-3 + 0.5 * x[:, 0])
    counts = rng.negative_binomial(1 / 0.5, 1 / (1 + 0.5 * mu))
    nb = stats.nb2(x[:, :1], counts.astype(float), e)
    assert np.allclose(nb["beta"], [-3, 0.5], atol=0.12) and abs(nb["alpha"] - 0.5) < 0.1
    design = np.column_stack([np.ones(800), x[:, 0]])
    assert np.abs(design.T @ ((counts - nb["mu"]) / (1 + nb["alpha"] * nb["mu"]))).max() < 1e-3  # the score equation
    assert abs(stats.chi2_sf(3.841459, 1) - 0.05) < 1e-6 and abs(stats.student_sf2(1.96, 1e6) - 0.05) < 1e-3
    points = np.concatenate([rng.standard_normal((30, 2)), rng.standard_normal((30, 2)) + 20])
    labels = np.repeat([0, 1], 30)
    assert stats.silhouette(points, labels) > 0.85 and stats.davies_bouldin(points, labels) < 0.3
    assert sorted(np.bincount(stats.folds(23))) == [4, 4, 5, 5, 5]


def test_index_and_sensitivity(spark):
    df = spark.createDataFrame([(i, float(i), None if i == 3 else float(-i), float(i % 4)) for i in range(1, 41)], "k int, t double, q double, inc double")
    parts = model.components(df, "t", ["q"], "inc")
    index = model.composite_index(parts)
    assert index.filter("indice IS NULL").count() == 1 and index.filter("indice < 0 OR indice > 1").count() == 0
    assert len(model.scenarios()) == 29
    out = {r.cenario: r for r in model.sensitivity(parts, "k", tops=(10,), scaled=model.components(df, "t", ["q"], "inc", how="minmax")).collect()}
    assert out["0.8x0.8x0.8"].spearman_geral == pytest.approx(1) and out["0.8x0.8x0.8"].retencao_top10 == 1 and len(out) == 30
    assert out["0.8x0.8x0.8"].spearman_top10 == pytest.approx(1) and 0 < out["sem_talent"].retencao_top10 < 1 and "minmax" in out
    kw = model.kruskal_wallis(spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0), ("b", 4.0)], "g string, v double"), "g", "v").first()
    assert kw.h == pytest.approx(2.4) and kw.p == pytest.approx(0.1213, abs=1e-3)
    pr = model.precision_recall(spark.createDataFrame([(1, 1), (1, 0), (0, 1), (1, None)], "p int, t int"), "p", "t").first()
    assert (pr.n, pr.precisao, pr.cobertura) == (3, 0.5, 0.5)
    lab = spark.createDataFrame([("auto", "1"), ("auto", "0"), ("auto", " "), ("revisao", "1")], "link_status string, correto string")
    strata = spark.createDataFrame([("auto", 90), ("revisao", 10), ("sem_match", 5)], "link_status string, n_linhas int")
    got = {r.link_status: r for r in model.link_precision(lab, strata).collect()}
    assert got["auto"].precisao == 0.5 and got["auto"].precisao_ponderada == pytest.approx(0.55) and got["sem_match"].precisao is None


def test_serving(spark, tmp_path):
    cells = spark.createDataFrame([("enem", "EM", "2023", "todas", "uf", "SP", "SP", 500.0, 20, False), ("enem", "EM", "2023", "todas", "municipio", "SP", "3550308", 510.0, 12, False), ("saeb", "EF2", "2019", "publica", "uf", "SP", "SP", None, 3, True)], "prova string, etapa string, ano string, rede string, nivel string, uf string, codigo string, valor double, n long, suprimido boolean")
    path = f"file://{tmp_path}/cells"
    serve.write_cells(cells, path)
    stored = spark.read.option("basePath", path).parquet(path)
    listed = {r.prova: r.asDict() for r in serve.catalog(cells).collect()}
    ask = lambda **q: serve.resolve({"prova": "enem", "etapa": "EM", "ano": "2023", "rede": "todas"} | q, listed, {"SP", "RJ"})
    assert [r.codigo for r in serve.map_cells(stored, ask(nivel="municipio", uf="SP")).collect()] == ["3550308"]
    assert serve.map_cells(stored, ask()).columns == serve.CELL
    for bad, status in ((dict(prova="x"), 400), (dict(nivel="x"), 400), (dict(nivel="municipio", uf="XX"), 400), (dict(nivel="municipio"), 400), (dict(etapa="EF2"), 422), (dict(ano="1990"), 422), (dict(rede="privada"), 422), (dict(sexo="F"), 422), (dict(renda="baixa"), 422)):
        with pytest.raises(serve.RequestError) as e:
            ask(**bad)
        assert e.value.status == status
    assert serve.adjust({"prova": "saeb", "etapa": "EM", "ano": "2023", "rede": "todas"}, listed) == {"prova": "saeb", "etapa": "EF2", "ano": "2019", "rede": "publica"}
    index = spark.createDataFrame([("uf", "35", "São Paulo", "SP"), ("municipio", "3550308", "São Paulo", "SP"), ("municipio", "3300001", "Nova São Paulo", "RJ"), ("escola", "00000001", "Colégio Paulo de Tarso", "SP"), ("escola", "00000002", "Tarso Xpaulo", "SP")], "tipo string, codigo string, nome string, uf string")
    assert [(r.codigo, r.pontos) for r in serve.search(index, "sao pau").collect()] == [("35", 0), ("3550308", 0), ("3300001", 1)]
    assert [(r.codigo, r.pontos) for r in serve.search(index, "paulo tarso").collect()] == [("00000001", 1), ("00000002", 2)]
    assert [r.codigo for r in serve.search(index, "sp").collect()] == ["35"]
    assert [r.codigo for r in serve.search(index, "355").collect()] == ["3550308"] and serve.search(index, "a").count() == 0
    medal = spark.createDataFrame([("k1", "Ana Silva", "Prata", 2026, "EM", "E1"), ("k2", "Beto", "Ouro", 2024, "EM", "E2"), ("k3", "Caio", "Ouro", 2016, "EF2", None), ("k4", "Davi", "Menção Honrosa", 2026, "EF2", None)], "aluno_key string, nome string, medalha string, ano int, etapa string, escola string")
    audit_path = f"file://{tmp_path}/audit"
    shown = serve.audited(spark, audit_path, "u", "medalhistas", "3550308", "2026-01-01T00:00:00Z", lambda: serve.medalists(medal, 2026, SALT))
    assert "nome" not in shown.columns and [(r.medalha, r.ano) for r in shown.collect()] == [("Ouro", 2016), ("Prata", 2026)]
    assert spark.read.json(audit_path).count() == 1
    assert "nome" in serve.medalists(medal, 2026, SALT, show_names=True).columns
    fav = spark.createDataFrame([("u", "1")], "usuario string, codigo string")
    two = serve.favourites_add(fav, "u", "2")
    assert two.count() == 2 and serve.favourites_add(two, "u", "2").count() == 2 and serve.favourites_remove(two, "u", "1").count() == 1
    with pytest.raises(serve.RequestError):
        serve.favourites_add(two, "u", "3", limit=2)
    groups = spark.createDataFrame([("SP", "a"), ("3550308", "b")], "codigo string, grupo string")
    assert [(r.codigo, r.posicao) for r in serve.group_filter(cells, groups, ["a"]).filter("valor IS NOT NULL").collect()] == [("SP", 2)]
    assert serve.largest_centroid([[(0, 0), (2, 0), (2, 2), (0, 2)], [(5, 5), (5.1, 5), (5.1, 5.1)]]) == (1.0, 1.0)


def test_panels(spark):
    index = spark.createDataFrame([("1", "E1", "c", "SP", "EF2", 2021, 5.0, 6.0, 5.5, "publica", "Municipal"), ("1", "E1b", "c", "SP", "EF2", 2023, 6.0, None, 5.6, "publica", "Municipal"), ("2", "E2", "c", "SP", "EF2", 2023, 4.0, 4.0, 4.0, "publica", "Estadual")], "co_entidade string, no_escola string, co_municipio string, uf string, etapa string, ano int, nota_saeb_lp double, nota_saeb_mt double, ideb double, rede_grupo string, rede string")
    members = spark.createDataFrame([("2",)], "co_entidade string")
    listed = serve.school_list(index, members)
    assert {(r.co_entidade, r.destaque, r.nota) for r in listed.collect()} == {("1", True, 6.0), ("2", True, 4.0)}
    panel = serve.panels(listed, spark.createDataFrame([("c", 10)], "co_municipio string, populacao long"), spark.createDataFrame([("c", "OBI", "Ouro", 2)], "co_municipio string, olimpiada string, medalha string, n long")).first()
    assert '"no_escola":"E1b"' in panel.painel and '"medalha":"Ouro"' in panel.painel
    sheet = {r.co_entidade: r for r in serve.school_sheets(index, spark.createDataFrame([("1", 3)], "co_entidade string, n long")).collect()}
    assert sheet["1"].no_escola == "E1b" and sheet["1"].n_premios == 3 and len(sheet["1"].series["EF2"]) == 2 and sheet["2"].n_premios == 0


def test_whole_run(spark, cities, school_dim, tmp_path):
    from meridia.plans import orchestrate

    w = orchestrate.Workspace(spark, f"file://{tmp_path}")
    w.write("dim_municipio_base", cities.withColumns({"regiao": F.lit("SE")}))
    dim = school_dim.withColumns({"uf": F.lit("SP"), "rede": F.when(F.col("rede_publica"), "Municipal").otherwise("Privada"), "ultimo_ano": F.lit(2023), "fonte": F.lit("ideb")})
    w.write("dim_escola_base", dim)
    w.write("medalhistas", award_rows(spark))
    w.write("enem_all", exam.conform(exam_raw(spark), exam.source(2023, "microdados")))
    index = dim.select("co_entidade", "no_escola", "co_municipio", "uf", F.lit("EF2").alias("etapa"), F.lit(2023).alias("ano"), "rede", F.lit(200.0).alias("nota_saeb_lp"), F.lit(210.0).alias("nota_saeb_mt"), F.lit(5.5).alias("nota_saeb_padronizada"), F.lit(5.0).alias("ideb"), F.lit(0.9).alias("indicador_rendimento"), F.lit(95.0).alias("taxa_aprovacao"))
    w.write("ideb_escola", index)
    w.write("ideb_municipio", index.filter("co_entidade = '00000001'").drop("co_entidade", "no_escola"))
    w.write("saeb_escola", spark.createDataFrame([("SP", "EF2", 2023, "publica", 250.0, 260.0, 20, 5.0, 3)], "uf string, etapa string, ano int, rede string, proficiencia_lp double, proficiencia_mt double, n_alunos int, inse_aluno_medio double, n_alunos_inse int"))
    report = orchestrate.run(w, SALT, n_min=1)
    assert {r.regra: r.n for r in report.collect() if r.n} == {}
    fact = w.read("fato_desempenho")
    assert fact.columns == star.FACT and {r.fonte for r in fact.select("fonte").distinct().collect()} == {"enem", "ideb", "saeb", "olimpiadas"}
    cells = w.read("map_cells")
    assert {r.prova for r in cells.select("prova").distinct().collect()} == {"saeb", "enem", "obmep", "obi"}
    assert cells.filter("suprimido AND valor IS NOT NULL OR NOT suprimido AND valor IS NULL").count() == 0
    saeb = cells.filter("prova = 'saeb'").collect()
    assert {(r.nivel, r.valor) for r in saeb} == {("municipio", 205.0), ("uf", 255.0)}
    assert [s for s, _ in w.timings] == ["linkage", "agregacoes", "star", "celulas"] and w.timing_table().count() == 4
    assert orchestrate.profile(w, "dim_aluno").filter("coluna = 'aluno_hash' AND pct_nulo = 0").count() == 1


def test_socioeconomic_cells(spark, cities):
    rows = spark.createDataFrame([("3550308", 2023, 5.0, 10, True), ("3550308", 2023, 6.0, 30, True), ("3550308", 2023, 9.0, 99, False), ("3500001", 2023, None, 5, True)], "co_municipio string, ano int, inse double, n_alunos long, rede_publica boolean")
    got = {(r.nivel, r.etapa, r.codigo): (r.valor, r.n, r.suprimido) for r in serve.socioeconomic_cells(rows, cities).collect()}
    assert got[("municipio", "EM", "3550308")] == got[("uf", "EF2", "SP")] == (5.75, 40, False)
    assert got[("municipio", "EF2", "3500001")] == (None, None, True)
    latest = serve.latest_by_priority(spark.createDataFrame([("a", 2021, 1.0), ("a", 2023, None), ("a", 2019, 3.0)], "k string, ano int, v double"), "k", "v").first()
    assert latest.v == 1.0


def test_kmeans_indices_are_exact_without_all_pairs_at_the_driver(spark, monkeypatch):
    rng = np.random.RandomState(2)
    points = np.concatenate([rng.normal(m, 1.0, (60, 2)) for m in (0, 6, 13)])
    points = np.concatenate([points, points[:50], points[:20]])  # copies count each
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)], "i int, a double, b double").repartition(3)
    whole = stats.silhouette
    monkeypatch.setattr(stats, "silhouette", None)
    rows, table = model.kmeans(df, "i", ["a", "b"], ks=(3, 2), restarts=2)
    got = rows.orderBy("i").toPandas()
    scaled = (points - points.mean(axis=0)) / points.std(axis=0, ddof=1)
    labels = got["cluster"].to_numpy()
    best = max(table.collect(), key=lambda r: r.silhueta)
    assert len(got) == len(points) and best.k == len(set(labels)) == 3
    assert abs(best.silhueta - whole(scaled, labels)) < 1e-9
    assert abs(best.davies_bouldin - stats.davies_bouldin(scaled, labels)) < 1e-9


def _blobs(n: int, dims: int, seed: int = 4):
    rng = np.random.RandomState(seed)
    points = np.concatenate([rng.normal(m, 1.0, (n // 3, dims)) for m in (0, 3, 7)])
    labels = {3: np.repeat([0, 1, 2], n // 3), 2: np.repeat([4, 9, 9], n // 3)}
    return points, rng.randint(1, 4, len(points)).astype(float), labels


@pytest.mark.parametrize("dims", [1, 3, 5])
def test_bounds_hold_the_exact_sums_of_distances(dims, monkeypatch):
    monkeypatch.setattr(stats.Places, "LEAF", 16)
    points, weights, labels = _blobs(1800, dims)
    places = stats.Places(points, weights, labels).grow()
    table = {k: np.array([0.0, 0.0, 0.0]) for k in labels}
    widths = {0.4: [], 0.1: []}
    for block in range(places.blocks()):
        rows = places.rows(block)
        d = np.sqrt(((places.points[rows, None] - places.points[None]) ** 2).sum(axis=2)) * places.weights
        want = np.column_stack([d[:, places.own[k] == c].sum(axis=1) for k, span in places.spans.items() for c in range(span.start, span.stop)])
        exact = places.direct(rows, np.arange(len(points)))
        assert np.allclose(exact, want, rtol=1e-12)
        for theta, widest in widths.items():
            sums, error = places.bounds(block, theta)
            assert (np.abs(sums - want) <= error + 1e-9 * want).all()
            widest.append(error.max())
        for (k, low, high), (_, least, most) in zip(places.scores(rows, exact), places.scores(rows, sums, error)):
            assert low == high
            table[k] += (least, low, most)
    assert max(widths[0.1]) < max(widths[0.4])
    copies = np.repeat(np.arange(len(points)), weights.astype(int))
    for k, (least, exact, most) in table.items():
        assert least - 1e-9 <= exact <= most + 1e-9
        assert abs(exact / weights.sum() - stats.silhouette(points[copies], labels[k][copies])) < 1e-9


def test_k_of_many_points_is_chosen_without_all_pairs(spark, monkeypatch):
    """The table is measured when it is read; k is the same as by the table."""
    points, _, _ = _blobs(3000, 2)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)], "i int, a double, b double")
    exact = []
    inner = model._silhouettes
    monkeypatch.setattr(model, "_FEW_POINTS", 100)
    monkeypatch.setattr(model, "_silhouettes", lambda spark, sent, theta=None: exact.append(theta) or inner(spark, sent, theta))
    monkeypatch.setattr(model, "_all_pairs", lambda *_: pytest.fail("all pairs were measured to choose k"))
    rows, table = model.kmeans(df, "i", ["a", "b"], ks=(2, 3, 6), restarts=1)
    assert 0.4 in exact and rows.count() == len(points)
    best = max(table.collect(), key=lambda r: r.silhueta)
    got = rows.orderBy("i").toPandas()["cluster"].to_numpy()
    scaled = (points - points.mean(axis=0)) / points.std(axis=0, ddof=1)
    assert best.k == len(set(got)) and abs(best.silhueta - stats.silhouette(scaled, got)) < 1e-9


def test_k_that_bounds_leave_open_is_chosen_by_all_pairs(spark, monkeypatch):
    points, weights, labels = _blobs(900, 2)
    monkeypatch.setattr(model, "_FEW_POINTS", 100)
    same = stats.Places(points, weights, {5: labels[3], 3: labels[3]})
    best, rows = model._best(spark, same)
    assert best == 5 and len({r.silhueta for r in rows.collect()}) == 1
