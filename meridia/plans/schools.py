"""School tables: assessment, index sheets, municipality and school dimensions, proficiency aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import domain, text
from ..operators import suppress, windows
from ..operators.aggregate import weighted_mean_null_as_zero


def student_index(students: DataFrame) -> DataFrame:
    """Mean and number of the students' index by stage and school, where the flag is 1."""
    rows = students.filter(text.blank_to_null(F.col("IN_INSE")).try_cast("int") == 1)
    value = text.blank_to_null(F.col("INSE_ALUNO")).try_cast("double")
    return rows.groupBy("etapa", text.padded(F.col("ID_ESCOLA"), 8).alias("id_escola_saeb")).agg(F.avg(value).alias("inse_aluno_medio"), F.count(value).alias("n_alunos_inse"))


def assessment(raw: DataFrame, year: int, students: DataFrame | None = None) -> DataFrame:
    """One row for each school and stage of a school-level file; unknown states drop out, both metrics null too."""
    spark = raw.sparkSession
    states = F.broadcast(spark.createDataFrame(list(config.STATE_CODES.items()), "cod_uf int, uf string"))
    have = set(raw.columns)
    number = lambda c: text.blank_to_null(F.col(c)).try_cast("double") if c in have else F.lit(None).cast("double")
    parts = []
    for stage, suffixes in (("EF2", ("9EF",)), ("EM", ("EM", "3EM"))):
        suffix = next((s for s in suffixes if f"MEDIA_{s}_LP" in have), None)
        if suffix is None:
            continue
        parts.append(raw.select(
            F.lit(year).alias("ano"), F.lit(stage).alias("etapa"), text.padded(F.col("ID_ESCOLA"), 8).alias("id_escola_saeb"),
            text.padded(F.col("ID_MUNICIPIO"), 7).alias("id_municipio_saeb"), text.blank_to_null(F.col("ID_UF")).try_cast("int").alias("cod_uf"),
            F.when(F.trim("IN_PUBLICA") == "1", "publica").when(F.trim("IN_PUBLICA") == "0", "privada").alias("rede"),
            F.when(F.trim("ID_LOCALIZACAO") == "1", "urbana").when(F.trim("ID_LOCALIZACAO") == "2", "rural").alias("localizacao"),
            number(f"MEDIA_{suffix}_LP").alias("proficiencia_lp"), number(f"MEDIA_{suffix}_MT").alias("proficiencia_mt"),
            F.round(number(f"NU_PRESENTES_{suffix}")).cast("int").alias("n_alunos"), F.round(number(f"NU_MATRICULADOS_CENSO_{suffix}")).cast("int").alias("n_matriculados_censo"),
            (text.blank_to_null(F.col("NIVEL_SOCIO_ECONOMICO")) if "NIVEL_SOCIO_ECONOMICO" in have else F.lit(None).cast("string")).alias("inse_escola"),
            F.lit("grupo" if year == 2017 else "nivel").alias("inse_escala"),
        ))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.filter("n_alunos IS NOT NULL OR proficiencia_lp IS NOT NULL").join(states, "cod_uf").drop("cod_uf")
    if students is None:
        return out.withColumns({"inse_aluno_medio": F.lit(None).cast("double"), "n_alunos_inse": F.lit(None).cast("long")})
    return out.join(student_index(students), ["etapa", "id_escola_saeb"], "left")


def index_long(sheet: DataFrame, ids: list[str]) -> DataFrame:
    """Wide index sheet to rows (ids, ano, metrica, valor_texto), by the names of its columns."""
    import re

    found: list[tuple[str, str, int]] = []
    for c in sheet.columns:
        if m := re.fullmatch(rf"VL_({'|'.join(config.INDEX_METRICS)})_(\d{{4}})", c):
            found.append((c, config.INDEX_METRICS[m[1]], int(m[2])))
        elif m := re.fullmatch(r"VL_APROVACAO_(\d{4})_(SI_4|[1-4])", c):
            found.append((c, config.PASS_RATE_METRICS[m[2]], int(m[1])))
    entries = [F.struct(F.lit(m).alias("metrica"), F.lit(y).alias("ano"), F.col(c).cast("string").alias("valor_texto")) for c, m, y in found]
    return sheet.select(*ids, F.explode(F.array(*entries)).alias("e")).select(*ids, "e.*")


def index_oddities(long: DataFrame) -> DataFrame:
    """Counts of texts that are neither numbers nor known signs for no data, and of numbers with asterisks."""
    raw = F.trim("valor_texto")
    star = F.rlike(raw, F.lit(r"\A[\d.,]+\*+\z"))
    plain = F.regexp_replace(raw, r"\*+\z", "")
    odd = text.not_available_to_number(F.col("valor_texto")).isNull() & ~plain.isin(*config.NOT_AVAILABLE)
    return long.select(F.when(star, "com_asterisco").when(odd, F.concat(F.lit("nao_numerico:"), plain)).alias("ocorrencia")).filter("ocorrencia IS NOT NULL").groupBy("ocorrencia").count()


def index_table(sheet: DataFrame, stage: str, school: bool) -> DataFrame:
    """Index rows (etapa, ids, ano, a column for each metric) of one sheet; footnote rows go."""
    ids = ["SG_UF", "CO_MUNICIPIO", "NO_MUNICIPIO", "REDE"] + (["ID_ESCOLA", "NO_ESCOLA"] if school else [])
    key = "ID_ESCOLA" if school else "CO_MUNICIPIO"
    rows = sheet.filter(text.full_match(F.coalesce(F.col(key), F.lit("")), r"\d{7,8}"))
    long = index_long(rows, ids).withColumn("valor", text.not_available_to_number(F.col("valor_texto"))).filter("valor IS NOT NULL")
    metrics = [*config.INDEX_METRICS.values(), *config.PASS_RATE_METRICS.values()]
    wide = long.groupBy(*ids, "ano").agg(*[F.first(F.when(F.col("metrica") == m, F.col("valor")), ignorenulls=True).alias(m) for m in metrics])
    names = {"SG_UF": "uf", "CO_MUNICIPIO": "co_municipio", "NO_MUNICIPIO": "no_municipio", "REDE": "rede", "ID_ESCOLA": "co_entidade", "NO_ESCOLA": "no_escola"}
    return wide.withColumnsRenamed({k: v for k, v in names.items() if k in ids}).withColumn("etapa", F.lit(stage))


def municipality_dimension(localities: DataFrame, census: DataFrame, estimate: DataFrame) -> DataFrame:
    """localities: nested records; census and estimate: co_municipio, ano, populacao."""
    def path(p: str):
        node = localities.schema
        for part in p.split("."):
            if not hasattr(node, "fieldNames") or part not in node.fieldNames():
                return F.lit(None).cast("string")
            node = node[part].dataType
        return F.col(p)

    by_meso, by_inter = "microrregiao.mesorregiao.UF", "regiao-imediata.regiao-intermediaria.UF"
    quoted = by_inter.replace("regiao-imediata", "`regiao-imediata`").replace("regiao-intermediaria", "`regiao-intermediaria`")
    second = lambda leaf: F.col(f"{quoted}.{leaf}") if "regiao-imediata" in localities.columns else F.lit(None).cast("string")
    base = localities.select(
        text.digits_code(F.col("id"), 7).alias("co_municipio"), F.col("nome").alias("no_municipio"),
        F.coalesce(path(f"{by_meso}.sigla"), second("sigla")).alias("uf"), F.coalesce(path(f"{by_meso}.regiao.sigla"), second("regiao.sigla")).alias("regiao"),
    )
    c = census.select("co_municipio", F.col("populacao"), F.col("ano").alias("ano_populacao"))
    e = estimate.select("co_municipio", F.col("populacao").alias("populacao_estimada"), F.col("ano").alias("ano_populacao_estimada"))
    return base.join(c, "co_municipio", "left").join(e, "co_municipio", "left")


def school_dimension(index: DataFrame) -> DataFrame:
    """Last known record of each school: latest year, then stage in order."""
    last = windows.latest_row(index, ["co_entidade"], F.col("ano").desc(), F.col("etapa").asc(), F.col("rede").asc())
    return last.select("co_entidade", "no_escola", "co_municipio", "uf", "rede", (F.col("rede") != "Privada").alias("rede_publica"), F.col("ano").alias("ultimo_ano"), F.lit("ideb").alias("fonte"))


def proficiency(index: DataFrame) -> DataFrame:
    """Index rows as proficiency aggregates: no count, suppressed where the publisher shows nothing."""
    group, detail = domain.network(F.col("rede"), "index")
    out = index.withColumns({"rede_grupo": group, "rede_detalhe": detail, "co_municipio": text.digits_code(F.col("co_municipio"), 7), "n": F.lit(None).cast("long")})
    if "co_entidade" in index.columns:
        out = out.withColumn("co_entidade", text.digits_code(F.col("co_entidade"), 8))
    return suppress.inherited(out, ["nota_saeb_lp", "nota_saeb_mt", "ideb"])


def state_proficiency(schools: DataFrame, n_min: int = 10) -> DataFrame:
    """State means weighted by students present. The mathematics mean has the language weight, and null
    mathematics counts as 0 under it, as in the published tables."""
    group, _ = domain.network(F.col("rede"), "assessment")
    rows = schools.withColumn("rede_grupo", group).dropna(subset=["uf", "etapa", "ano", "rede_grupo"])
    weight = F.when(F.col("proficiencia_lp").isNotNull(), F.col("n_alunos"))
    out = rows.groupBy("uf", "etapa", "ano", "rede_grupo").agg(
        F.count(F.lit(1)).alias("n_escolas"), F.count("proficiencia_lp").alias("n_escolas_com_proficiencia"),
        F.coalesce(F.sum("n_alunos"), F.lit(0)).cast("long").alias("n"),
        weighted_mean_null_as_zero(F.col("proficiencia_lp"), weight).alias("proficiencia_lp_media"),
        weighted_mean_null_as_zero(F.col("proficiencia_mt"), weight).alias("proficiencia_mt_media"),
        weighted_mean_null_as_zero(F.col("inse_aluno_medio"), F.col("n_alunos_inse")).alias("inse_aluno_medio"),
        F.coalesce(F.sum("n_alunos_inse"), F.lit(0)).cast("long").alias("n_alunos_inse"),
    )
    return suppress.by_count(out, "n", ["proficiencia_lp_media", "proficiencia_mt_media", "inse_aluno_medio"], n_min)
