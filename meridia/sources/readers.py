"""Scans. No schema inference anywhere: text columns are typed later, by the conforming projections."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text


def delimited(spark: SparkSession, path: str, sep: str = ";", encoding: str = "ISO-8859-1", pattern: str | None = None) -> DataFrame:
    """All-text CSV, tolerant of broken quoting. With a pattern, files of that name anywhere below the path."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern) if pattern else spark.read
    return reader.csv(path, sep=sep, header=True, encoding=encoding, inferSchema=False, mode="PERMISSIVE", multiLine=False)


def labelled_sample(spark: SparkSession, path: str) -> DataFrame:
    """All-text CSV in which blanks stay blank."""
    rows = spark.read.csv(path, header=True, inferSchema=False)
    return rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in rows.columns])


def parquet(spark: SparkSession, *paths: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(*paths)
    return df.select(*columns) if columns else df


def _names(spark: SparkSession, root: str) -> set[str]:
    """Names of all files below a folder of any file system."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(root)
    found, files = set(), path.getFileSystem(sc._jsc.hadoopConfiguration()).listFiles(path, True)
    while files.hasNext():
        found.add(files.next().getPath().getName())
    return found


def available_years(spark: SparkSession, root: str, files: dict[int, list[str]]) -> dict[int, list[str]]:
    """Years of which all files are there."""
    there = _names(spark, root)
    return {year: names for year, names in files.items() if set(names) <= there}


def missing_years(spark: SparkSession, root: str, files: dict[int, list[str]]) -> list[int]:
    return sorted(set(files) - set(available_years(spark, root, files)))


def wide_sheet(spark: SparkSession, path: str, header_row: int = 10) -> DataFrame:
    """A sheet's text export: the header is on a given row, columns without a name are dropped.

    Spreadsheets themselves need a reader that is not part of this package; export them as
    semicolon-separated text."""
    lines = spark.read.text(path, wholetext=False)
    header = lines.offset(header_row - 1).first()[0].split(";")
    rows = spark.read.csv(path, sep=";", header=False, inferSchema=False, schema=", ".join(f"c{i} string" for i in range(len(header))))
    keep = [(i, h.strip()) for i, h in enumerate(header) if h.strip() and not h.startswith("Unnamed")]
    key = keep[0][1]
    return rows.select(*[F.col(f"c{i}").alias(h) for i, h in keep]).filter(F.col(key).isNotNull() & (F.col(key) != key))


# Column names of the socioeconomic index sheets, by edition.
SOCIOECONOMIC_COLUMNS = {"CO_ESCOLA": "ID_ESCOLA", "NOME_ESCOLA": "NO_ESCOLA", "CO_MUNIC": "CO_MUNICIPIO", "INSE_VALOR_ABSOLUTO": "MEDIA_INSE", "INSE_CLASSIFICACAO2": "INSE_CLASSIFICACAO"}


def socioeconomic_index(sheet: DataFrame, year: int) -> DataFrame:
    d = sheet.withColumnsRenamed({k: v for k, v in SOCIOECONOMIC_COLUMNS.items() if k in sheet.columns and v not in sheet.columns})
    return d.select(
        text.digits_code(F.col("ID_ESCOLA"), 8).alias("co_entidade"), text.digits_code(F.col("CO_MUNICIPIO"), 7).alias("co_municipio"),
        F.col("TP_TIPO_REDE").alias("tipo_rede"), F.col("QTD_ALUNOS_INSE").try_cast("double").cast("long").alias("n_alunos"),
        text.not_available_to_number(F.col("MEDIA_INSE")).alias("inse"), F.col("INSE_CLASSIFICACAO").alias("classificacao"), F.lit(year).alias("ano"),
    )


def dictionary_categories(rows: DataFrame, order: str, heading: str) -> DataFrame:
    """Carries a variable's heading down to its category rows. Dictionaries have some hundred rows: one partition."""
    from pyspark.sql import Window

    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(heading, F.last(F.when(F.trim(heading) != "", F.col(heading)), ignorenulls=True).over(w))


def population_series(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array whose first element is a header; values that are no numbers become null."""
    raw = spark.read.schema("D1C string, D3C string, V string").json(path, multiLine=True)
    code = F.rlike("D1C", F.lit(r"\A[0-9]+\z"))
    return raw.filter(code).select(text.digits_code(F.col("D1C"), 7).alias("co_municipio"), F.col("D3C").try_cast("int").alias("ano"), F.col("V").try_cast("long").alias("populacao"))


LOCALITY_SCHEMA = (
    "id long, nome string, microrregiao struct<mesorregiao: struct<UF: struct<sigla: string, regiao: struct<sigla: string>>>>, "
    "`regiao-imediata` struct<`regiao-intermediaria`: struct<UF: struct<sigla: string, regiao: struct<sigla: string>>>>"
)


def localities(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOCALITY_SCHEMA).json(path, multiLine=True)


def literal(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def rules(path: str) -> dict:
    """A YAML rule file."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)
