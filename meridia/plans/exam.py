"""Exam micro-data: conforming per edition, and the municipal aggregates with suppression."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions import domain, text
from ..operators import suppress
from ..operators.aggregate import percent

# Output column -> type: the contract of the conformed table.
COLUMNS = {
    "ano": "int", "origem": "string", "co_escola": "string", "co_escola_mascarado": "boolean", "co_municipio_esc": "string",
    "sg_uf_esc": "string", "co_municipio_prova": "string", "sg_uf_prova": "string", "tp_escola": "tinyint", "tp_sexo": "string",
    "tp_st_conclusao": "tinyint", "tp_dependencia_adm_esc": "tinyint", "nu_nota_cn": "double", "nu_nota_ch": "double",
    "nu_nota_lc": "double", "nu_nota_mt": "double", "nu_nota_redacao": "double", "q005": "smallint", "q006": "string",
    "renda_familiar_faixa": "string",
}
WIDTHS = {"co_escola": 8, "co_municipio_esc": 7, "co_municipio_prova": 7}
AREAS = ("cn", "ch", "lc", "mt", "redacao")


@dataclass(frozen=True)
class Source:
    """One file of an edition: where it is from, and where its columns differ from their upper-case names."""

    year: int
    origin: str
    renames: dict[str, str] = field(default_factory=dict)


def source(year: int, origin: str) -> Source:
    """From 2024 on participants and results can't be joined, and the income letter moves to Q007."""
    income = "Q006" if year < 2024 else "Q007"
    return Source(year, origin, {"renda_familiar_faixa": income})


def conform(raw: DataFrame, src: Source) -> DataFrame:
    """All-text columns to the contract; columns that the file lacks become typed nulls."""
    have = {c.upper(): c for c in raw.columns}
    out = []
    for name, kind in COLUMNS.items():
        column = have.get(src.renames.get(name, name).upper())
        if name == "ano":
            value = F.lit(src.year)
        elif name == "origem":
            value = F.lit(src.origin)
        elif name == "co_escola_mascarado":
            code = have.get("CO_ESCOLA")
            value = F.substring(text.blank_to_null(F.col(code)), 1, 1) == "6" if code else F.lit(None)
        elif column is None:
            value = F.lit(None)
        elif name in WIDTHS:
            value = text.padded(F.col(column), WIDTHS[name])
        elif kind in ("tinyint", "smallint"):
            value = F.round(text.blank_to_null(F.col(column)).try_cast("double")).try_cast(kind)
        elif kind == "double":
            value = text.blank_to_null(F.col(column)).try_cast("double")
        else:
            value = text.blank_to_null(F.col(column))
        out.append(value.cast(kind).alias(name))
    return raw.select(*out)


def bands(spark: SparkSession) -> DataFrame:
    rows = [(a, float(b), None if c is None else float(c), float(d)) for a, b, c, d in config.INCOME_BANDS]
    return F.broadcast(spark.createDataFrame(rows, "faixa string, lim_inf double, lim_sup double, pm double"))


def profile(exam: DataFrame) -> DataFrame:
    """Income, sex and school type of those who finish school, by test municipality and year.

    n_inscritos_total counts everyone; a conditional count replaces a second pass and its join."""
    rows = exam.filter(F.col("origem").isin("microdados", "participantes") & F.col("co_municipio_prova").isNotNull())
    rows = rows.join(bands(exam.sparkSession), F.col("renda_familiar_faixa") == F.col("faixa"), "left")
    cohort = F.coalesce(domain.completes_school(F.col("tp_st_conclusao")), F.lit(False))
    valid = cohort & F.col("q005").between(1, 20) & F.col("pm").isNotNull()
    per = lambda c: domain.per_head(F.col(c), F.col("q005"))
    certain = F.col("lim_sup").isNotNull() & (per("lim_sup") <= config.LOW_INCOME)
    kind = cohort & F.col("tp_escola").isin(2, 3)
    count = lambda p: F.count(F.when(p, 1))
    out = rows.groupBy(F.col("co_municipio_prova").alias("co_municipio"), "ano").agg(
        count(cohort).alias("n"), F.count(F.lit(1)).alias("n_inscritos_total"), count(valid).alias("n_renda_valida"),
        percent(per("pm") <= config.LOW_INCOME, valid).alias("pct_renda_pc_le_1_5_ponto_medio"),
        percent(certain, valid).alias("pct_certamente_le_1_5"),
        percent(~certain & (per("lim_inf") < config.LOW_INCOME), valid).alias("pct_possivelmente_le_1_5"),
        percent(per("lim_inf") >= config.LOW_INCOME, valid).alias("pct_acima_1_5"),
        F.median(F.when(valid, per("pm"))).alias("mediana_renda_pc_sm"),
        count(cohort & (F.col("tp_sexo") == "F")).alias("n_feminino"), count(cohort & (F.col("tp_sexo") == "M")).alias("n_masculino"),
        count(kind).alias("n_tp_escola_valido"), percent(F.col("tp_escola") == 2, kind).alias("pct_publica_tp_escola"),
    ).filter("n > 0")
    return out.select(
        F.lit("perfil_prova").alias("visao"), "co_municipio", "ano", F.lit("todas").alias("rede_grupo"), F.lit("EM_tp_st_conclusao").alias("recorte"),
        *[c for c in out.columns if c not in ("co_municipio", "ano")],
        (F.col("mediana_renda_pc_sm") * domain.minimum_wage(F.col("ano"))).alias("mediana_renda_pc_reais"),
    )


def scores(exam: DataFrame) -> DataFrame:
    """Valid scores: two geographies, all networks and each. One scan: every row goes to its up to four cells."""
    group, _ = domain.exam_network(F.col("tp_dependencia_adm_esc"), F.col("tp_escola"))
    rows = exam.filter(F.col("origem").isin("microdados", "resultados"))
    rows = rows.filter((F.col("origem") == "resultados") | domain.completes_school(F.col("tp_st_conclusao")))
    valid = {a: domain.valid_score(F.col(f"nu_nota_{a}"), zero_ok=a == "redacao").alias(a) for a in AREAS}
    zeros = domain.zero_count(*[F.col(f"nu_nota_{a}") for a in AREAS[:4]]).alias("zeros")
    base = rows.select("ano", "origem", "co_municipio_prova", "co_municipio_esc", group.alias("rede"), *valid.values(), zeros)
    base = base.filter(F.coalesce(*AREAS).isNotNull())
    micro = F.col("origem") == "microdados"
    by_school = F.when(micro, "EM_tp_st_conclusao").otherwise("EM_via_escola_censo")
    everyone = F.when(micro, "EM_tp_st_conclusao").otherwise("sem_restricao_EM")
    cell = lambda view, city, net, cut: F.struct(F.lit(view).alias("visao"), F.col(city).alias("co_municipio"), net.alias("rede_grupo"), cut.alias("recorte"))
    cells = F.array(
        cell("desempenho_prova", "co_municipio_prova", F.lit("todas"), everyone), cell("desempenho_prova", "co_municipio_prova", F.col("rede"), by_school),
        cell("desempenho_escola", "co_municipio_esc", F.lit("todas"), by_school), cell("desempenho_escola", "co_municipio_esc", F.col("rede"), by_school),
    )
    long = base.withColumn("cell", F.explode(cells)).select("ano", "cell.*", *AREAS, "zeros").filter("co_municipio IS NOT NULL AND rede_grupo IS NOT NULL")
    aggs = [x for a in AREAS for x in (F.count(a).alias(f"n_{a}"), F.avg(a).alias(f"media_{a}"))]
    return long.groupBy("visao", "co_municipio", "ano", "rede_grupo", "recorte").agg(
        *aggs, percent(F.col("redacao") == 0).alias("pct_redacao_zero"), F.sum("zeros").alias("n_nota_zero_invalidada"), F.count(F.lit(1)).alias("n")
    )


def municipal(exam: DataFrame, n_min: int | None = None) -> DataFrame:
    """Profile and scores under the per-metric suppression policy."""
    m = n_min if n_min is not None else config.Suppression().n_min("agg_enem_municipio")
    out = profile(exam).unionByName(scores(exam), allowMissingColumns=True)
    income = ("pct_renda_pc_le_1_5_ponto_medio", "pct_certamente_le_1_5", "pct_possivelmente_le_1_5", "pct_acima_1_5", "mediana_renda_pc_sm", "mediana_renda_pc_reais")
    own = {c: "n_renda_valida" for c in income} | {"pct_publica_tp_escola": "n_tp_escola_valido"} | {f"media_{a}": f"n_{a}" for a in AREAS}
    out = suppress.by_own_base(out, own, m)
    out = suppress.by_own_base(out, {"pct_redacao_zero": "n_redacao"}, m, null_base_hides=True)
    hidden = [c for c in out.columns if c.startswith(("media_", "pct_"))] + ["n_feminino", "n_masculino"]
    return suppress.by_count(out, "n", hidden, m)
