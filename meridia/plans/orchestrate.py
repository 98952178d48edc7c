"""Stages over one root folder: plain functions, timed, with the filesystem between them.

Every stage reads tables by name and writes tables by name, so any of them can run again alone.
There is no global state: the root is an argument."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregate import null_rates
from ..sources import sinks
from . import awards, exam, linkage, schools, serve, star


@dataclass
class Workspace:
    spark: SparkSession
    root: str
    timings: list[tuple[str, float]] = field(default_factory=list)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def write(self, name: str, df: DataFrame) -> DataFrame:
        sinks.parquet(df, f"{self.root}/{name}")
        return self.read(name)

    def stage(self, name: str, run: Callable[[], object]):
        began = time.perf_counter()
        out = run()
        self.timings.append((name, round(time.perf_counter() - began, 3)))
        return out

    def timing_table(self) -> DataFrame:
        return self.spark.createDataFrame(self.timings or [], "etapa string, segundos double")


def link_awards(w: Workspace) -> None:
    """medalhistas, dim_municipio_base, dim_escola_base -> linkage_resultado, medalhistas_enriquecido, aluno_dedup."""
    cities, dim = w.read("dim_municipio_base"), w.read("dim_escola_base")
    rows = linkage.with_row_ids(w.read("medalhistas"), *awards.COLUMNS)
    ready = w.write("medalhistas_preparados", linkage.prepare_awards(rows, cities))
    links = w.write("linkage_resultado", linkage.link_table(ready, dim))
    enriched, people = linkage.enrich(ready, links)
    w.write("medalhistas_enriquecido", enriched)
    w.write("aluno_dedup", people)
    sinks.csv(linkage.review_queue(links, cities), f"{w.root}/linkage_revisao_manual")


def aggregate(w: Workspace, n_min: int = 10) -> None:
    """Conformed tables -> the five aggregates."""
    w.write("agg_enem_municipio", exam.municipal(w.read("enem_all"), n_min))
    w.write("agg_proficiencia_escola", schools.proficiency(w.read("ideb_escola")))
    w.write("agg_proficiencia_municipio", schools.proficiency(w.read("ideb_municipio")))
    w.write("agg_proficiencia_uf", schools.state_proficiency(w.read("saeb_escola"), n_min))
    w.write("agg_medalhas_municipio", awards.medal_cells(w.read("medalhistas_enriquecido"), n_min=n_min))


def build_star(w: Workspace, salt: str) -> DataFrame:
    """Aggregates and identities -> star schema; returns the contract report, which must be all zeros."""
    tables = {
        "dim_municipio": w.write("dim_municipio", w.read("dim_municipio_base")),
        "dim_escola": w.write("dim_escola", star.school_dimension(w.read("dim_escola_base"))),
        "dim_aluno": w.write("dim_aluno", star.person_dimension(w.read("aluno_dedup"), salt)),
        "fato_medalhas": w.write("fato_medalhas", star.award_fact(w.read("medalhistas_enriquecido"), salt)),
        "fato_desempenho": w.write("fato_desempenho", star.performance_fact(*[w.read(f"agg_{n}") for n in ("enem_municipio", "proficiencia_escola", "proficiencia_municipio", "proficiencia_uf", "medalhas_municipio")])),
    }
    leaks = [star.name_leaks(tables[t], w.read("aluno_dedup")) for t in ("dim_aluno", "fato_medalhas")]
    if any(df.limit(1).count() for df in leaks):
        raise AssertionError("a published table holds a person's name")
    references = [("fato_medalhas", "aluno_hash", "dim_aluno", "aluno_hash"), ("fato_desempenho", "co_municipio", "dim_municipio", "co_municipio")]
    return star.contract_report(tables, references)


def publish_cells(w: Workspace) -> DataFrame:
    """All map cells of all exams, written by slice."""
    cities = w.read("dim_municipio_base")
    cells = serve.assessment_cells(w.read("agg_proficiencia_municipio"), w.read("agg_proficiencia_uf"))
    cells = cells.unionByName(serve.exam_cells(w.read("agg_enem_municipio"), cities)).unionByName(serve.medal_map_cells(w.read("agg_medalhas_municipio"), cities))
    serve.write_cells(cells, f"{w.root}/map_cells")
    return w.read("map_cells")


def profile(w: Workspace, table: str) -> DataFrame:
    """Rows and null rate of every column, in one pass."""
    df = w.read(table)
    n = df.count()
    return null_rates(df, df.columns).withColumns({"tabela": F.lit(table), "linhas": F.lit(n)})


def run(w: Workspace, salt: str, n_min: int = 10) -> DataFrame:
    """Linkage, aggregates, star schema and cells, in their order."""
    w.stage("linkage", lambda: link_awards(w))
    w.stage("agregacoes", lambda: aggregate(w, n_min))
    report = w.stage("star", lambda: build_star(w, salt))
    w.stage("celulas", lambda: publish_cells(w))
    return report
