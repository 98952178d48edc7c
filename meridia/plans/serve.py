"""Serving layer: map cells by slice, catalog, requests against closed lists, panels, search, audited lists."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import domain, text
from ..operators import windows
from ..operators.aggregate import mean_of_all, mean_of_known, ratio_means

SLICE = ["prova", "etapa", "ano", "rede", "nivel"]
CELL = ["codigo", "valor", "n", "suprimido"]
FIRST_YEAR, LAST_YEAR = 2016, 2025


def _cells(df: DataFrame, exam: str, level: str, code: str, value: str, n: str, n_min: int) -> DataFrame:
    cells = df.withColumns({"suprimido": F.col(value).isNull() | F.coalesce(F.col(n) < n_min, F.lit(False)), "__v": F.col(value), "__n": F.col(n).cast("long")})
    return cells.select(
        F.lit(exam).alias("prova"), "etapa", F.col("ano").cast("string").alias("ano"), "rede", F.lit(level).alias("nivel"), "uf",
        F.col(code).alias("codigo"), F.when(~F.col("suprimido"), F.bround("__v", 2)).alias("valor"), F.col("__n").alias("n"), "suprimido",
    )


def assessment_cells(by_city: DataFrame, by_state: DataFrame, n_min: int = 10) -> DataFrame:
    """Municipalities from the index sheets, states from the assessment itself: mean of both subjects, null if one is."""
    city = by_city.filter(F.col("rede_grupo") == "publica").select("etapa", "ano", F.col("rede").alias("rede"), "uf", "co_municipio", mean_of_all(F.col("nota_saeb_lp"), F.col("nota_saeb_mt")).alias("v"), F.lit(None).cast("long").alias("q"))
    state = by_state.select("etapa", "ano", F.col("rede_grupo").alias("rede"), "uf", mean_of_all(F.col("proficiencia_lp_media"), F.col("proficiencia_mt_media")).alias("v"), F.col("n").alias("q"))
    return _cells(city, "saeb", "municipio", "co_municipio", "v", "q", n_min).unionByName(_cells(state, "saeb", "uf", "uf", "v", "q", n_min))


def exam_cells(municipal: DataFrame, cities: DataFrame, n_min: int = 10) -> DataFrame:
    """Mean of the five scores by municipality; states are weighted means of the municipalities that are shown."""
    five = mean_of_all(*[F.col(f"media_{a}") for a in ("cn", "ch", "lc", "mt", "redacao")])
    city = municipal.filter(F.col("visao") == "desempenho_escola").join(cities.select("co_municipio", "uf"), "co_municipio")
    city = city.select(F.lit("EM").alias("etapa"), "ano", F.col("rede_grupo").alias("rede"), "uf", "co_municipio", five.alias("v"), F.col("n").alias("q"))
    shown = city.filter(F.col("v").isNotNull() & (F.col("q") >= n_min))
    state = ratio_means(shown, ["etapa", "ano", "rede", "uf"], "v", "q")
    return _cells(city, "enem", "municipio", "co_municipio", "v", "q", n_min).unionByName(_cells(state, "enem", "uf", "uf", "valor", "n", n_min))


def medal_map_cells(medals: DataFrame, cities: DataFrame, n_min: int = 1) -> DataFrame:
    """Awards per 100k inhabitants, for every municipality: 0 without awards, and then suppressed.

    Awards of mixed stage count in both stages; the year todos is the sum of all. Raw counts are
    summed first, thresholds come last."""
    stages = F.when(F.col("etapa") == "EF2_EM", F.array(F.lit("EF2"), F.lit("EM"))).otherwise(F.array("etapa"))
    rows = medals.withColumn("etapa", F.explode(stages)).filter(F.col("etapa").isin("EF2", "EM") & F.col("ano").between(FIRST_YEAR, LAST_YEAR))
    rows = rows.withColumn("ano", F.explode(F.array(F.col("ano").cast("string"), F.lit("todos"))))
    counts = rows.groupBy("olimpiada", "etapa", "ano", "co_municipio").agg(F.sum("n").alias("n"))
    slices = F.broadcast(counts.select("olimpiada", "etapa", "ano").distinct())  # a few dozen rows: competition, stage, year
    every = cities.select("co_municipio", "uf", "populacao").crossJoin(slices)
    full = every.join(counts, ["olimpiada", "etapa", "ano", "co_municipio"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    full = full.withColumn("rede", F.lit("todas"))
    rate = lambda n, p: F.try_divide(n, p) * 1e5
    city = full.withColumn("v", rate(F.col("n"), F.col("populacao")))
    state = full.groupBy("olimpiada", "etapa", "ano", "rede", "uf").agg(F.sum("n").alias("n"), F.sum("populacao").alias("populacao")).withColumn("v", rate(F.col("n"), F.col("populacao")))
    out = []
    for df, level, code in ((city, "municipio", "co_municipio"), (state, "uf", "uf")):
        kept = df.withColumns({"suprimido": F.col("v").isNull() | (F.col("n") < n_min)})
        out.append(kept.select(
            F.lower("olimpiada").alias("prova"), "etapa", "ano", "rede", F.lit(level).alias("nivel"), "uf", F.col(code).alias("codigo"),
            F.when(~F.col("suprimido"), F.bround("v", 2)).alias("valor"), F.col("n").cast("long").alias("n"), "suprimido",
        ))
    return out[0].unionByName(out[1])


def socioeconomic_cells(schools: DataFrame, cities: DataFrame, n_min: int = 10) -> DataFrame:
    """Index of public schools weighted by students, at both grains; the same values for both stages."""
    rows = schools.filter("rede_publica").join(cities.select("co_municipio", "uf"), "co_municipio")
    rows = rows.withColumn("etapa", F.explode(F.array(F.lit("EF2"), F.lit("EM")))).withColumn("rede", F.lit("publica"))
    city = ratio_means(rows, ["etapa", "ano", "rede", "uf", "co_municipio"], "inse", "n_alunos")
    state = ratio_means(rows, ["etapa", "ano", "rede", "uf"], "inse", "n_alunos")
    return _cells(city, "inse", "municipio", "co_municipio", "valor", "n", n_min).unionByName(_cells(state, "inse", "uf", "uf", "valor", "n", n_min))


def latest_by_priority(rows: DataFrame, key: str, value: str, year: str = "ano") -> DataFrame:
    """The value of the latest edition that has one."""
    return windows.latest_row(rows.filter(F.col(value).isNotNull()), [key], F.col(year).desc(), F.col(value).desc())


def write_cells(cells: DataFrame, path: str) -> None:
    """All slices in one job, a folder for each; requests then read single partitions."""
    cells.write.mode("overwrite").partitionBy(*SLICE).parquet(path)


def catalog(cells: DataFrame) -> DataFrame:
    """What may be asked for: stages, years and networks of each exam."""
    lists = [F.sort_array(F.collect_set(c)).alias(o) for c, o in (("etapa", "etapas"), ("ano", "anos"), ("rede", "redes"))]
    return cells.select("prova", "etapa", "ano", "rede").distinct().groupBy("prova").agg(*lists)


class RequestError(ValueError):
    def __init__(self, status: int, reason: str):
        super().__init__(reason)
        self.status, self.reason = status, reason


@dataclass(frozen=True)
class MapRequest:
    prova: str
    etapa: str
    ano: str
    rede: str = "todas"
    nivel: str = "uf"
    uf: str | None = None


def resolve(query: dict, listed: dict[str, dict], states: set[str], offers: tuple[str, ...] = ()) -> MapRequest:
    """Checks a request against closed lists: 400 for what no list has, 422 for what this exam lacks.

    listed: exam -> {etapas, anos, redes}; offers: extra filters (sexo, renda) that are available."""
    level = query.get("nivel", "uf")
    if level not in ("uf", "municipio"):
        raise RequestError(400, "nivel desconhecido")
    state = query.get("uf")
    if level == "municipio" and state not in states or state is not None and state not in states:
        raise RequestError(400, "uf desconhecida")
    exam = listed.get(query.get("prova"))
    if exam is None:
        raise RequestError(400, "prova desconhecida")
    for name, column in (("etapas", "etapa"), ("anos", "ano"), ("redes", "rede")):
        if str(query.get(column)) not in map(str, exam[name]):
            raise RequestError(422, f"{column} indisponivel para {query['prova']}")
    for extra in ("sexo", "renda"):
        if query.get(extra) not in (None, "", "todos", "todas") and extra not in offers:
            raise RequestError(422, f"{extra} indisponivel")
    return MapRequest(query["prova"], query["etapa"], str(query["ano"]), query["rede"], level, state)


def adjust(query: dict, listed: dict[str, dict]) -> dict:
    """The nearest request that the catalog has: the first stage, last year, first network where a choice isn't offered."""
    exam = listed[query["prova"]]
    pick = lambda value, options, default: value if value in options else options[default]
    return query | {"etapa": pick(query.get("etapa"), exam["etapas"], 0), "ano": pick(query.get("ano"), exam["anos"], -1), "rede": pick(query.get("rede"), exam["redes"], 0)}


def map_cells(cells: DataFrame, request: MapRequest) -> DataFrame:
    """The cells of one slice: filters on partition columns, so one folder is read."""
    out = cells.filter(" AND ".join(f"{c} = '{getattr(request, c)}'" for c in SLICE))
    if request.nivel == "municipio":
        out = out.filter(F.col("uf") == request.uf)
    return out.select(*CELL)


def school_list(index: DataFrame, medal_schools: DataFrame, share: float = 0.9) -> DataFrame:
    """Schools of the latest edition of each stage; destaque: top decile in the state and stage, or with awards."""
    last = index.groupBy("etapa").agg(F.max("ano").alias("ano"))
    rows = index.join(F.broadcast(last), ["etapa", "ano"]).filter("rede_grupo = 'publica'")
    rows = rows.withColumn("nota", mean_of_known(F.col("nota_saeb_lp"), F.col("nota_saeb_mt")))
    return windows.top_share_or_member(rows, ["uf", "etapa"], "nota", medal_schools, "co_entidade", share)


def panels(schools: DataFrame, context: DataFrame, medals: DataFrame) -> DataFrame:
    """One nested document for each municipality: schools by stage, context, awards."""
    listed = schools.groupBy("co_municipio", "etapa").agg(
        F.max("ano").alias("ano"),
        F.sort_array(F.collect_list(F.struct((-F.coalesce("nota", F.lit(-1.0))).alias("o"), "co_entidade", "no_escola", "nota", "destaque", "membro"))).alias("lista"),
    )
    by_city = listed.groupBy("co_municipio").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("etapa", F.struct("ano", "lista"))))).alias("escolas"))
    won = medals.groupBy("co_municipio").agg(F.sort_array(F.collect_list(F.struct("olimpiada", "medalha", "n"))).alias("medalhas"))
    return context.join(by_city, "co_municipio", "left").join(won, "co_municipio", "left").withColumn("painel", F.to_json(F.struct("populacao", "escolas", "medalhas")))


def by_state_documents(rows: DataFrame, key: str, document: str) -> DataFrame:
    """One JSON map for each state. Key order is fixed, so files are the same from run to run."""
    entries = F.sort_array(F.collect_list(F.struct(F.col(key), F.col(document))))
    return rows.groupBy("uf").agg(F.to_json(F.map_from_entries(entries)).alias("documento"))


def school_sheets(index: DataFrame, medal_counts: DataFrame) -> DataFrame:
    """Series by stage, latest attributes and number of awards of each public school."""
    rows = index.filter("rede_grupo = 'publica'").dropna(how="all", subset=["nota_saeb_lp", "nota_saeb_mt", "ideb"])
    point = F.struct("ano", "nota_saeb_lp", "nota_saeb_mt", "ideb")
    series = rows.groupBy("co_entidade", "etapa").agg(F.sort_array(F.collect_list(point)).alias("serie"))
    series = series.groupBy("co_entidade").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("etapa", "serie")))).alias("series"))
    last = windows.latest_row(rows, ["co_entidade"], F.col("ano").desc(), F.col("etapa").asc()).select("co_entidade", "no_escola", "co_municipio", "uf", "rede")
    won = medal_counts.groupBy("co_entidade").agg(F.sum("n").alias("n_premios"))
    return last.join(series, "co_entidade").join(won, "co_entidade", "left").withColumn("n_premios", F.coalesce("n_premios", F.lit(0)))


def search(index: DataFrame, query: str, per_type: int = 5, least: int = 2) -> DataFrame:
    """index: tipo (uf, municipio, others as schools), codigo, nome, uf. Score 0 for a prefix, 1 for a word's prefix, 2 within.

    States match by their uf or name, all of them; digits match the codes of the others. Cities hold the whole
    query; schools hold all its words and are scored by the first. By score and then name, ``per_type`` of each type."""
    folded = lambda c: F.lower(text.ascii_fold(c))
    want = index.sparkSession.range(1).select(F.trim(folded(F.lit(query))).alias("q")).first()["q"]
    if len(want) < least:
        return index.limit(0).withColumns({"pontos": F.lit(None).cast("int")})
    words, state = want.split(), F.col("tipo") == "uf"

    def score(term: str) -> Column:
        n = F.col("__n")
        return F.when(F.startswith(n, F.lit(term)), 0).when(F.contains(n, F.lit(f" {term}")), 1).when(F.contains(n, F.lit(term)), 2)

    whole = F.lit(True)
    for word in words:
        whole = whole & F.contains(F.col("__n"), F.lit(word))
    by_name = F.when(state | (F.col("tipo") == "municipio"), score(want)).otherwise(F.when(whole, score(words[0])))
    if want.isdigit():
        by_name = F.when(state, score(want)).otherwise(F.when(F.startswith(F.col("codigo"), F.lit(want)), 0))
    points = F.coalesce(by_name, F.when(state & (F.lower("uf") == want), 0))
    hits = index.withColumn("__n", F.coalesce(folded(F.col("nome")), F.lit(""))).withColumn("pontos", points).filter("pontos IS NOT NULL")
    order = ("pontos", "__n", "nome", "codigo")
    best = hits.filter(state).unionByName(windows.top_k(hits.filter(F.coalesce(~state, F.lit(True))), ["tipo"], per_type, *map(F.col, order)))
    kind = F.when(F.col("tipo") == "uf", 0).when(F.col("tipo") == "municipio", 1).otherwise(2)
    return best.orderBy(kind, *order).drop("__n")


def medalists(awards: DataFrame, current_year: int, salt: str, show_names: bool = False) -> DataFrame:
    """Eligible medalists, honourable mentions aside, by medal and then latest year; names only when asked for."""
    rows = awards.filter(F.col("medalha").isin("Ouro", "Prata", "Bronze"))
    upper = domain.is_upper_secondary(F.col("etapa"), F.coalesce("escola", F.lit("")))
    rows = rows.filter(domain.eligible(upper, F.col("ano"), current_year))
    order = F.when(F.col("medalha") == "Ouro", 0).when(F.col("medalha") == "Prata", 1).otherwise(2)
    out = rows.withColumns({"pseudonimo": domain.pseudonym(salt, F.col("nome"), F.col("aluno_key")), "__o": order})
    out = out.orderBy("__o", F.desc("ano"), "pseudonimo").drop("__o")
    return out if show_names else out.drop("nome", "aluno_key")


def audit_append(spark: SparkSession, path: str, user: str, action: str, target: str, when: str) -> None:
    """One appended audit line. Call it before the read it stands for: if it fails, nothing is shown."""
    spark.createDataFrame([(when, user, action, target)], "quando string, usuario string, acao string, alvo string").write.mode("append").json(path)


def audited(spark: SparkSession, path: str, user: str, action: str, target: str, when: str, read):
    audit_append(spark, path, user, action, target, when)
    return read()


def favourites_add(current: DataFrame, user: str, code: str, limit: int = 200) -> DataFrame:
    """A user's list with one more code: no change if it is there, an error beyond the limit."""
    mine = current.filter(F.col("usuario") == user)
    if mine.filter(F.col("codigo") == code).limit(1).count():
        return current
    if mine.count() >= limit:
        raise RequestError(422, f"limite de {limit} favoritos")
    return current.unionByName(current.sparkSession.createDataFrame([(user, code)], "usuario string, codigo string"))


def favourites_remove(current: DataFrame, user: str, code: str) -> DataFrame:
    return current.filter(~((F.col("usuario") == user) & (F.col("codigo") == code)))


def group_filter(cells: DataFrame, groups: DataFrame, wanted: list[str]) -> DataFrame:
    """Cells of places in the wanted groups, with the competition rank that they have among all.

    A value's rank is one more than the number of greater values: the average rank less half of its ties."""
    ties = cells.filter("valor IS NOT NULL").groupBy(F.col("valor").alias("__t")).agg(F.count(F.lit(1)).alias("__c"))
    ranked = windows.global_rank(cells, "valor", "__r", descending=True).join(ties, F.col("valor") == F.col("__t"), "left")
    ranked = ranked.withColumn("posicao", (F.col("__r") - (F.col("__c") - 1) / 2).cast("int")).drop("__r", "__t", "__c")
    return ranked.join(groups.filter(F.col("grupo").isin(*wanted)), "codigo", "left_semi")


def centroid(ring: list[tuple[float, float]]) -> tuple[float, float]:
    """Area-weighted centroid of a closed ring."""
    area = x = y = 0.0
    for (x0, y0), (x1, y1) in zip(ring, [*ring[1:], ring[0]]):
        cross = x0 * y1 - x1 * y0
        area, x, y = area + cross, x + (x0 + x1) * cross, y + (y0 + y1) * cross
    if area == 0:
        return sum(p[0] for p in ring) / len(ring), sum(p[1] for p in ring) / len(ring)
    return x / (3 * area), y / (3 * area)


def largest_centroid(rings: list[list[tuple[float, float]]]) -> tuple[float, float]:
    size = lambda r: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, [*r[1:], r[0]])))
    return centroid(max(rings, key=size))

