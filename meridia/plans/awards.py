"""Award tables: stacking competitions, medal cells, the later competition, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import domain, text
from ..operators import joins, suppress
from ..operators.aggregate import coverage
from . import linkage

COLUMNS = {
    "olimpiada": "string", "ano": "smallint", "nivel": "string", "modalidade": "string", "medalha": "string", "nome": "string",
    "escola_nome": "string", "rede": "string", "municipio_nome": "string", "uf": "string", "posicao": "smallint",
}


def stack(*competitions: DataFrame) -> DataFrame:
    """One table of the contract's columns and types; what a competition lacks is null."""
    parts = [d.select(*[(F.col(c) if c in d.columns else F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()]) for d in competitions]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def medal_cells(awards: DataFrame, cities: DataFrame | None = None, n_min: int = 10) -> DataFrame:
    """Counts by municipality, year, competition, medal, stage and network.

    awards with co_municipio and aluno_key count identities too; others are matched to cities
    by name, and have no count of identities."""
    if "co_municipio" not in awards.columns:
        awards = linkage.attach_city(awards, cities, "municipio_nome", "uf")
    stage = domain.stage(F.col("olimpiada"), F.col("modalidade"), F.col("nivel"))
    group, _ = domain.network(F.col("rede"), "awards")
    rows = awards.withColumns({
        "etapa": F.coalesce(stage, F.lit("indefinida")), "rede_grupo": F.coalesce(group, F.lit("desconhecida")),
        "no_escopo_ef2_em": domain.in_scope(stage), "co_municipio": text.digits_code(F.col("co_municipio"), 7),
    }).filter("co_municipio IS NOT NULL")
    people = F.countDistinct("aluno_key") if "aluno_key" in awards.columns else F.lit(None).cast("long")
    keys = ["co_municipio", "ano", "olimpiada", "medalha", "etapa", "rede_grupo"]
    cells = rows.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), people.alias("n_alunos_unicos"), F.first("no_escopo_ef2_em").alias("no_escopo_ef2_em"))
    return suppress.publishable_count(suppress.by_count(cells, "n", ["n_alunos_unicos"], n_min), "n")


def medal_totals(cells: DataFrame, n_min: int = 1) -> DataFrame:
    """By municipality, competition and medal, over all years; small totals left out."""
    return cells.groupBy("co_municipio", "olimpiada", "medalha").agg(F.sum("n").alias("n")).filter(F.col("n") >= n_min)


def public_competition(rows: DataFrame, cities: DataFrame, schools: DataFrame, rules=linkage.LinkRules()) -> DataFrame:
    """A competition of public schools alone: linked like the others under the public network, with its own identities."""
    placed = linkage.attach_city(rows, cities, "municipio_nome", "uf").withColumn("rede", F.coalesce("rede", F.lit("E")))
    ready = placed.withColumns({
        "escola_norm": text.school_name(F.col("escola_nome")), "nome_norm": text.person_name(F.col("nome")), "rede_grp": F.lit("publica"),
    })
    links = linkage.link_table(ready, schools, rules)
    got = joins.null_safe(ready, links.select(*linkage.KEY, "link_status", "co_entidade"), linkage.KEY)
    mixed = F.col("nivel").isin("1", "4")
    return got.withColumns({
        "co_entidade": F.when(F.col("link_status") == "auto", F.col("co_entidade")),
        "id_aluno": domain.sha1_identity(F.col("olimpiada"), F.col("nome_norm"), F.col("co_municipio"), F.col("ano")),
        "etapa": domain.stage(F.col("olimpiada"), F.lit(None).cast("string"), F.col("nivel")),
        "aviso": F.when(mixed, F.concat(F.lit("nivel "), F.col("nivel"), F.lit(" mistura series"))),
    })


def award_coverage(awards: DataFrame, by: list[str]) -> DataFrame:
    return coverage(awards, by, ["escola_nome", "municipio_nome", "uf", "rede", "nivel"])


def gaps(awards: DataFrame, years: list[int], competitions: list[str]) -> DataFrame:
    """Target years and competitions without any row."""
    spark = awards.sparkSession
    wanted = spark.createDataFrame([(c, y) for c in competitions for y in years], "olimpiada string, ano int")
    return wanted.join(awards.select("olimpiada", F.col("ano").cast("int").alias("ano")).distinct(), ["olimpiada", "ano"], "left_anti")
