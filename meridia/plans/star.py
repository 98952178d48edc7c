"""Star schema: dimensions, facts without names, and the contracts that they must keep."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import domain, text
from ..operators import joins, suppress, windows
from ..operators.aggregate import melt

KEYS = {
    "dim_municipio": ["co_municipio"], "dim_escola": ["co_entidade"], "dim_aluno": ["aluno_hash"], "fato_medalhas": ["medalha_hash"],
    "fato_desempenho": ["grao", "co_municipio", "co_entidade", "uf", "ano", "etapa", "rede_grupo", "metrica", "recorte", "fonte"],
}
FORBIDDEN = ("nome", "nome_norm", "aluno_nome", "no_aluno")
FACT = ["grao", "co_municipio", "co_entidade", "uf", "ano", "etapa", "rede_grupo", "fonte", "recorte", "metrica", "valor", "n", "suprimido"]


def school_dimension(schools: DataFrame) -> DataFrame:
    group, detail = domain.network(F.col("rede"), "index")
    return schools.drop("rede_publica").withColumns({"rede_grupo": group, "rede_detalhe": detail, "provisorio": F.lit(True)})


def person_dimension(people: DataFrame, salt: str) -> DataFrame:
    """No names: a salted hash of the identity and what it won."""
    keep = [c for c in people.columns if c.startswith(("n_", "primeiro", "ultimo"))] + ["co_municipio", "uf", "co_entidade"]
    return people.select(domain.salted_hash(salt, F.col("aluno_key")).alias("aluno_hash"), *keep)


def award_fact(awards: DataFrame, salt: str) -> DataFrame:
    """One row for each award row; equal rows are told apart by their occurrence."""
    same = ["aluno_key", "olimpiada", "ano", "modalidade", "nivel", "medalha"]
    rows = windows.occurrence_index(awards, same, "row_id")
    return rows.select(
        domain.salted_hash(salt, *[F.col(c) for c in (*same, "ocorrencia")]).alias("medalha_hash"), domain.salted_hash(salt, F.col("aluno_key")).alias("aluno_hash"),
        "olimpiada", "ano", "modalidade", "nivel", "medalha", "co_municipio", "uf", "co_entidade", "link_status", "linha_duplicada",
        domain.stage(F.col("olimpiada"), F.col("modalidade"), F.col("nivel")).alias("etapa"),
    )


def _long(df: DataFrame, grain: str, source: str, metrics: list[str], cut=None) -> DataFrame:
    for c in ("co_municipio", "co_entidade", "uf", "etapa", "n", "rede_grupo"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string" if c != "n" else "long"))
    df = df.withColumn("recorte", cut if cut is not None else F.lit(None).cast("string")).withColumn("n", F.col("n").cast("long"))
    keys = ["co_municipio", "co_entidade", "uf", "ano", "etapa", "rede_grupo", "recorte", "n"]
    return melt(df, keys, metrics).withColumns({"grao": F.lit(grain), "fonte": F.lit(source)}).select(*FACT)


def performance_fact(exam: DataFrame, by_school: DataFrame, by_city: DataFrame, by_state: DataFrame, medals: DataFrame) -> DataFrame:
    """Long metric rows of five aggregates; medal cells show their count only where it may be published."""
    index = ["nota_saeb_lp", "nota_saeb_mt", "ideb"]
    exam_metrics = [c for c in exam.columns if c.startswith(("media_", "pct_", "mediana_"))]
    exam = exam.withColumn("etapa", F.lit("EM"))
    cells = suppress.publishable_count(medals.groupBy("co_municipio", "ano", "etapa", "rede_grupo", "olimpiada", "medalha").agg(F.sum("n").alias("n"), (F.sum("n") < 10).alias("suprimido")), "n", out="n_medalhas")
    parts = [
        _long(exam, "municipio", "enem", exam_metrics, F.concat_ws(" | ", "visao", "recorte")),
        _long(by_school, "escola", "ideb", index), _long(by_city, "municipio", "ideb", index),
        _long(by_state, "uf", "saeb", ["proficiencia_lp_media", "proficiencia_mt_media", "inse_aluno_medio"]),
        _long(cells, "municipio", "olimpiadas", ["n_medalhas"], F.concat_ws(" | ", "olimpiada", F.concat(F.lit("medalha="), F.col("medalha")))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    fill = {"rede_grupo": "desconhecida", "etapa": "sem_etapa"}
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in fill.items()})


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once; null is a key like any other."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def key_audit(df: DataFrame, formats: dict[str, str]) -> DataFrame:
    """Rows (coluna, n_nulo, n_invalido, n_distinto) for key columns and their full-match patterns, in one pass."""
    aggs = []
    for c, pattern in formats.items():
        aggs += [F.count(F.when(F.col(c).isNull(), 1)).alias(f"{c}|n_nulo"), F.count(F.when(~text.full_match(F.col(c), pattern), 1)).alias(f"{c}|n_invalido"), F.countDistinct(c).alias(f"{c}|n_distinto")]
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("coluna"), *[F.col(f"`{c}|{m}`").alias(m) for m in ("n_nulo", "n_invalido", "n_distinto")]) for c in formats]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def name_leaks(df: DataFrame, names: DataFrame, name_col: str = "nome_norm") -> DataFrame:
    """Text values that equal a known name; forbidden columns are an error."""
    bad = [c for c in df.columns if c.lower() in FORBIDDEN]
    if bad:
        raise ValueError(f"columns that may name people: {bad}")
    texts = [c for c, t in df.dtypes if t == "string"]
    if not texts:
        return df.sparkSession.createDataFrame([], "coluna string, valor string")
    values = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("coluna"), F.col(c).alias("valor")) for c in texts])).alias("v")).select("v.*")
    known = names.select(text.person_name(F.col(name_col)).alias("__n")).filter("__n <> ''").distinct()
    return values.filter("valor IS NOT NULL").distinct().join(known, text.person_name(F.col("valor")) == F.col("__n"), "left_semi")


def contract_report(tables: dict[str, DataFrame], references: list[tuple[str, str, str, str]]) -> DataFrame:
    """Rows (regra, n): violations of keys, references and the suppression invariant; all 0 when the contract holds."""
    spark = next(iter(tables.values())).sparkSession
    parts = []
    one = lambda rule, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(rule).alias("regra"), "n")
    for name, df in tables.items():
        if name in KEYS:
            parts.append(one(f"chave unica {name}", duplicate_keys(df, KEYS[name])))
        if {"suprimido", "valor"} <= set(df.columns):
            parts.append(one(f"suprimido sem valor {name}", suppress.violations(df, ["valor"])))
    for fact, key, dim, dim_key in references:
        parts.append(one(f"{fact}.{key} em {dim}", joins.violations(tables[fact], key, tables[dim], dim_key)))
    return reduce(lambda a, b: a.unionByName(b), parts) if parts else spark.createDataFrame([], "regra string, n long")
