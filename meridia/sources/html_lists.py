"""Award lists and boards in HTML pages, PDF word boxes, student pages. Pages are parsed whole, in Arrow batches;
tables of a page become arrays, and everything after is columns."""

from __future__ import annotations

import re
import subprocess
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text

_CELL = T.StructType([T.StructField("text", T.StringType()), T.StructField("img", T.StringType())])
#: Tables of rows of cells.
TABLES = T.ArrayType(T.ArrayType(T.ArrayType(_CELL)))

#: Heading (folded) -> field of the award list.
HEADINGS = {"NOME": "nome", "ESCOLA": "escola_nome", "TIPO": "rede", "MUNICIPIO": "municipio_nome", "UF": "uf", "MEDALHA MENCAO": "medalha", "MEDALHA": "medalha", "POSICAO": "posicao", "": "posicao"}


class _Tables(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[list[str]]]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.cell = ["", ""]
            self.tables[-1][-1].append(self.cell)
        elif tag == "img" and self.cell is not None:
            self.cell[1] = dict(attrs).get("src") or ""

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell[0] += data


def tables_of(html: str | None) -> list:
    parser = _Tables()
    parser.feed(html or "")
    return [[[{"text": " ".join(t.split()), "img": i} for t, i in row] for row in table] for table in parser.tables]


@F.pandas_udf(TABLES)
def html_tables(pages: pd.Series) -> pd.Series:
    return pages.map(tables_of)


def award_rows(pages: DataFrame, html: str = "html") -> DataFrame:
    """Rows of all tables whose first row is a known heading: (page columns, tabela, linha, fields).

    One table for each level; placeholder rows (---) and rows without a name go."""
    keep = [c for c in pages.columns if c != html]
    t = pages.select(*keep, F.posexplode(html_tables(F.col(html))).alias("tabela", "t")).filter(F.size("t") > 1)
    head = F.transform(F.try_element_at("t", F.lit(1)), lambda c: text.base_text(c["text"]))
    rows = t.withColumn("head", head).select(*keep, "tabela", "head", F.posexplode(F.slice("t", F.lit(2), F.size("t"))).alias("linha", "r"))
    rows = rows.filter(F.array_contains("head", "NOME") & F.array_contains("head", "ESCOLA"))
    value = F.lit(None).cast("string")
    fields = {}
    for field in dict.fromkeys(HEADINGS.values()):
        value = F.lit(None).cast("string")
        for heading, name in HEADINGS.items():
            if name == field:
                at = F.array_position("head", heading)
                value = F.coalesce(value, F.when(at > 0, F.try_element_at("r", at.cast("int"))["text"]))
        fields[field] = value
    out = rows.select(*keep, "tabela", "linha", *[text.blank_to_null(v).alias(n) for n, v in fields.items()])
    return out.filter("nome IS NOT NULL AND nome NOT RLIKE '^-+$'")


def legitimately_empty(html: Column) -> Column:
    """A page that says that nobody was awarded."""
    return F.rlike(text.base_text(html), F.lit(r"NAO HOUVE|NENHUM (PREMIADO|RESULTADO)|SEM PREMIADOS"))


def board_rows(pages: DataFrame, html: str = "html") -> DataFrame:
    """Rows of seven cells: medal image, rank, score, name, school, city, state. The image's name tells the medal."""
    keep = [c for c in pages.columns if c != html]
    t = pages.select(*keep, F.posexplode(html_tables(F.col(html))).alias("tabela", "t"))
    rows = t.select(*keep, "tabela", F.posexplode("t").alias("linha", "r")).filter(F.size("r") == 7)
    cell = lambda i: F.try_element_at("r", F.lit(i + 1))
    image, mark = F.lower(cell(0)["img"]), F.upper(cell(0)["text"])
    medal = F.when(F.contains(image, F.lit("ouro")), "Ouro").when(F.contains(image, F.lit("prata")), "Prata").when(F.contains(image, F.lit("bronze")), "Bronze").when(mark == "HM", "Menção Honrosa")
    names = ("posicao", "nota", "nome", "escola_nome", "municipio_nome", "uf")
    out = rows.select(*keep, "tabela", "linha", medal.alias("medalha"), *[text.blank_to_null(cell(i)["text"]).alias(n) for i, n in enumerate(names, 1)], image.alias("imagem"))
    return out.filter("nome IS NOT NULL AND (medalha IS NOT NULL OR imagem <> '')")


def row_count(html: Column) -> Column:
    """Table rows in the raw page, to hold parsers against."""
    return F.regexp_count(F.lower(html), F.lit(r"<tr[\s>]"))


def anchors(pages: DataFrame, html: str = "html", pattern: str = ".*") -> DataFrame:
    """Links (url, titulo) of pages whose address matches; of links with one address the last title stands."""
    whole = r"""(?is)<a\s[^>]*href=["']([^"'#]+)["'][^>]*>(.*?)</a>"""
    keep = [c for c in pages.columns if c != html]
    pairs = F.arrays_zip(F.regexp_extract_all(html, F.lit(whole), F.lit(1)).alias("url"), F.regexp_extract_all(html, F.lit(whole), F.lit(2)).alias("titulo"))
    rows = pages.select(*keep, F.posexplode(pairs).alias("i", "a")).select(*keep, "i", "a.url", text.squeeze(F.regexp_replace("a.titulo", "<[^>]+>", " ")).alias("titulo"))
    last = rows.filter(F.rlike("url", F.lit(pattern))).groupBy(*keep, "url").agg(F.max_by("titulo", "i").alias("titulo"))
    return last


def edition_year(heading: Column, label: Column, configured: Column) -> Column:
    """Year of a page's heading, else its label, else the configured one; heading and label that differ are an error."""
    year = lambda c: F.regexp_extract(c, r"\b((?:19|20)\d\d)\b", 1).try_cast("int")
    h, lab = year(heading), year(label)
    clash = h.isNotNull() & lab.isNotNull() & (h != lab)
    return F.when(clash, F.raise_error(F.concat(F.lit("conflicting years: "), heading, F.lit(" / "), label)).cast("int")).otherwise(F.coalesce(h, lab, configured))


def text_lines(pages: DataFrame, html: str = "html") -> DataFrame:
    """(page columns, pos, linha): the lines of the text that a page shows."""
    keep = [c for c in pages.columns if c != html]
    plain = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " "), r"(?i)<(?:br|/?(?:p|div|li|ul|ol|h\d|tr|td|th|table|section))\b[^>]*>", "\n")
    plain = F.regexp_replace(plain, "<[^>]+>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(sign))
    lines = F.filter(F.transform(F.split(plain, "\n"), lambda x: text.squeeze(x)), lambda x: x != "")
    return pages.select(*keep, F.posexplode(lines).alias("pos", "linha"))


def label_value(lines: DataFrame, page: str, label: str) -> DataFrame:
    """The text after a label, on its line or the next; one row for each page that has it."""
    following = F.lead("linha").over(Window.partitionBy(page).orderBy("pos"))
    rows = lines.withColumn("__next", following).filter(F.lower("linha").startswith(label.lower()))
    rest = text.blank_to_null(F.regexp_replace(F.substr("linha", F.lit(len(label) + 1)), r"^\s*:\s*", ""))
    rows = rows.withColumn("valor", F.coalesce(rest, F.col("__next")))
    return rows.groupBy(page).agg(F.min_by("valor", "pos").alias("valor"))


def pdf_words(path: str) -> list[tuple[int, float, float, float, float, str]]:
    """(page, xMin, yMin, xMax, yMax, word) of a PDF, by the pdftotext program where it is installed."""
    out = subprocess.run(["pdftotext", "-bbox", path, "-"], capture_output=True, check=True, text=True).stdout
    found, page = [], 0
    word = re.compile(r'<word xMin="([\d.]+)" yMin="([\d.]+)" xMax="([\d.]+)" yMax="([\d.]+)">(.*?)</word>')
    for line in out.splitlines():
        page += "<page " in line
        if m := word.search(line):
            found.append((page, *map(float, m.groups()[:4]), m[5]))
    return found


#: Heads of the columns of the award PDF, from left to right.
PDF_HEADS = ("ESTUDANTE", "MUNICIPIO", "ESCOLA", "NIVEL", "PREMIACAO")


def pdf_rows(words: DataFrame, heads: tuple[str, ...] = PDF_HEADS, medals: tuple[str, ...] = ("OURO", "PRATA", "BRONZE", "MENCAO")) -> DataFrame:
    """Table rows from word boxes (arquivo, pagina, xmin, ymin, xmax, ymax, palavra).

    Columns are bounded midway between the heads' centres; each word belongs to the medal word
    that is nearest in height on its page. Pages have some hundred words, so the pairing within
    a page stays small; pages without heads use those of the file's first page."""
    folded = words.withColumns({"w": text.base_text(F.col("palavra")), "x": (F.col("xmin") + F.col("xmax")) / 2, "y": (F.col("ymin") + F.col("ymax")) / 2})
    head = folded.filter(F.col("w").isin(*heads)).groupBy("arquivo", "w").agg(F.min_by("x", F.struct("pagina", "y")).alias("x"), F.min_by("y", F.struct("pagina", "y")).alias("y"))
    centre = {h: F.max(F.when(F.col("w") == h, F.col("x"))).alias(f"c{i}") for i, h in enumerate(heads)}
    geometry = head.groupBy("arquivo").agg(*centre.values(), F.max("y").alias("head_y"))
    at_head = F.abs(F.col("y") - F.col("head_y")) < 1.5 * (F.col("ymax") - F.col("ymin"))
    body = folded.join(geometry, "arquivo").filter(~(F.col("w").isin(*heads) & at_head))
    column = F.lit(0)
    for i in range(1, len(heads)):
        column = F.when(F.col("x") > (F.col(f"c{i - 1}") + F.col(f"c{i}")) / 2, i).otherwise(column)
    body = body.withColumn("coluna", column)
    anchors_ = body.filter(F.col("w").isin(*medals) & (F.col("coluna") == len(heads) - 1)).select("arquivo", "pagina", F.col("y").alias("anchor_y"))
    pairs = body.join(anchors_, ["arquivo", "pagina"])
    near = Window.partitionBy("arquivo", "pagina", "palavra", "xmin", "ymin").orderBy(F.abs(F.col("y") - F.col("anchor_y")), "anchor_y")
    assigned = pairs.withColumn("__rn", F.row_number().over(near)).filter("__rn = 1")
    cells = assigned.groupBy("arquivo", "pagina", "anchor_y", "coluna").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.round("ymin").alias("l"), "xmin", "palavra"))), lambda s: s["palavra"]), " ").alias("t")
    )
    fields = [F.max(F.when(F.col("coluna") == i, F.col("t"))).alias(h.lower()) for i, h in enumerate(heads)]
    return cells.groupBy("arquivo", "pagina", "anchor_y").agg(*fields).withColumnRenamed("anchor_y", "y")


def repair_edges(df: DataFrame, name: str = "estudante", city: str = "municipio") -> DataFrame:
    """A surname that slid into the city column goes back (JUNIOR, NETO, FILHO); districts in brackets go."""
    suffix = F.regexp_extract(F.upper(city), r"^(J[UÚ]NIOR|NETO|FILHO|SOBRINHO)\b", 1)
    slid = suffix != ""
    moved = F.when(slid, F.trim(F.substr(F.col(city), F.length(suffix) + 1))).otherwise(F.col(city))
    return df.withColumns({
        name: F.when(slid, F.concat_ws(" ", F.col(name), F.substr(F.col(city), F.lit(1), F.length(suffix)))).otherwise(F.col(name)),
        city: text.squeeze(F.regexp_replace(moved, r"\([^)]*\)", " ")),
    })


def city_codes(rows: DataFrame, cities: DataFrame, city: str, state: str, default_state: str | None = None) -> DataFrame:
    """Code of a city name: with its state, then in the default state, then if the name is unique nationwide."""
    dim = cities.select("co_municipio", text.city_name(F.col("no_municipio")).alias("__k"), F.col("uf").alias("__uf"))
    keyed = rows.withColumn("__k", text.city_name(F.col(city)))
    cand = keyed.select("__k", F.col(state).alias("__want")).distinct().join(dim, "__k")
    rule = F.when(F.col("__want") == F.col("__uf"), 0).when(F.col("__want").isNull() & (F.col("__uf") == F.lit(default_state)), 1).when(F.col("__want").isNull(), 2)
    from ..operators.joins import null_safe

    ranked = cand.withColumn("__rule", rule).filter("__rule IS NOT NULL").groupBy("__k", "__want", "__rule").agg(F.countDistinct("co_municipio").alias("n"), F.min("co_municipio").alias("c"))
    everywhere = dim.groupBy("__k").agg(F.countDistinct("co_municipio").alias("n_all"))
    best = ranked.join(everywhere, "__k").filter((F.col("n") == 1) & ((F.col("__rule") < 2) | (F.col("n_all") == 1))).groupBy("__k", "__want").agg(F.min_by("c", "__rule").alias("co_municipio"))
    return null_safe(keyed.withColumn("__want", F.col(state)), best, ["__k", "__want"]).drop("__k", "__want")
