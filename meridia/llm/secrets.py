"""Operator 9 [native]: secret scan with corpus-wide ownership frequency.

Base findings come from three patterns (assign, access, hex), leftmost and without overlap
within a kind. Positions come from splitting the text at the matches: the pieces between them and the
matches, end to end, are the text, so running sums of lengths give every start.

The method then looks at candidate values over the whole corpus: the values of base
findings, and long mixed tokens (upper case, lower case and digits) that no pattern names.
Each value is aggregated by distinct repositories (documents) and owners (sources). A value
that many owners or many repositories have is a copied example; one that few of both have looks live. Mixed
tokens that look live add spans of kind ``token``; base spans always stay, and each
document gets the number of its live-looking and of its widely copied base values.

Aggregation is in steps, (value, owner, repository) to (value, owner) to value, each with
map-side combination, so one value in a third of all rows meets no single task. The text is read once
and never shuffled.

Defined results: null text is empty (no spans; base_sha256 is that of the empty string);
null owner or repository counts as one of its own; repeated rows are the same repository, and each gets a result
row; an empty table gives no rows; other columns are ignored, whatever their names; whole texts are scanned, in time
that grows with their length and with the findings of a text to the power 1.5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_or_empty

#: Kinds in their order: name, Java pattern, group of the value, least length of the value.
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)
#: With so many least characters, the pattern finds the same runs and skips the short ones.
FAST = {"hex": r"[0-9a-f]{32,}", "access": r"AKIA[A-Z0-9]{12,}"}
TOKEN = ("token", r"(?<![A-Za-z0-9_-])(?=[a-z0-9_-]*[A-Z])(?=[A-Z0-9_-]*[a-z])(?=[A-Za-z_-]*[0-9])[A-Za-z0-9_-]{20,}", 0, 20)
#: A value of more owners, or of more repositories, than these is a copied example.
MAX_OWNERS, MAX_REPOS, HOT_VALUES = 2, 10, 1000

_SPAN = "array<struct<start:int,kind:int,stop:int,value:long>>"


def _let(value: Column, body) -> Column:
    """body of a value that is computed once: an expression in a lambda is computed anew in each call."""
    return F.transform(F.array(value), body)[0]


def _spans(text: Column, no: int, pattern: str, group: int, least: int) -> Column:
    """The findings of one kind as structs (start, kind, stop, hash of the value)."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.split(text, pattern, -1)
    triples = F.zip_with(
        F.arrays_zip(whole.alias("m"), value.alias("v")), gaps,
        lambda a, gap: F.struct(F.length(gap).alias("gap"), F.length(a["m"]).alias("size"), F.length(a["v"]).alias("n"), F.xxhash64(a["v"]).alias("value")),
    )
    matched = F.filter(triples, lambda x: x["size"].isNotNull())

    def step(acc, x):
        at = acc["at"] + x["gap"]
        one = F.struct(at.alias("start"), F.lit(no).alias("kind"), (at + x["size"]).alias("stop"), x["value"].alias("value"))
        return F.struct(
            (at + x["size"]).alias("at"),
            F.when(x["n"] >= least, F.concat(acc["found"], F.array(one))).otherwise(acc["found"]).alias("found"),
        )

    def spans_of(part, offset):
        start = F.struct(offset.alias("at"), F.array().cast(_SPAN).alias("found"))
        return F.aggregate(part, start, step, lambda acc: acc["found"])

    # Running sums in two levels, by parts of about the square root of the findings: an array that grows
    # one by one is copied each time, so one level would be quadratic.
    def parted(m):
        n = F.ceil(F.sqrt(F.size(m))).cast("int")
        return _let(n, lambda n: F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda j: F.slice(m, j * n + 1, n)))

    def placed(parts):
        sums = F.transform(parts, lambda part: F.aggregate(part, F.lit(0), lambda acc, x: acc + x["gap"] + x["size"]))
        offsets = F.aggregate(sums, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
        return F.flatten(F.zip_with(parts, F.slice(offsets, 1, F.size(parts)), spans_of))

    found = _let(matched, lambda m: _let(parted(m), placed))
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(F.array().cast(_SPAN))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k[0]) for k in (*KINDS, TOKEN)])
    shown = F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string")))
    return F.array_join(shown, ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """Narrow rows (row_no, doc_id, owner, base, extra): spans without the text."""
    d = docs.select(
        F.monotonically_increasing_id().alias("row_no"), F.col(id_col).alias("doc_id"),
        F.col(owner_col).cast("string").alias("owner"), text_or_empty(text_col).alias("text"),
    )
    base = [_spans(F.col("text"), no, FAST.get(name, pattern), group, least) for no, (name, pattern, group, least) in enumerate(KINDS)]
    return d.select(
        "row_no", "doc_id", "owner", F.array_sort(F.concat(*base)).alias("base"),
        _spans(F.col("text"), len(KINDS), *TOKEN[1:]).alias("extra"),
    )


def ownership(found: DataFrame) -> DataFrame:
    """Rows (value, n_owners, n_repos) over all candidate values."""
    values = found.select("owner", "doc_id", F.explode(F.array_distinct(F.transform(F.concat("base", "extra"), lambda s: s["value"]))).alias("value"))
    repos = values.groupBy("value", "owner", "doc_id").agg(F.lit(1).alias("one"))
    owners = repos.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("n"))
    return owners.groupBy("value").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_repos"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS, hot_values: int = HOT_VALUES) -> DataFrame:
    """Rows (doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied), one per document."""
    found = materialize(scan(docs, id_col, text_col, owner_col), "findings")
    freq = materialize(ownership(found), "ownership")
    some = found.filter(F.size("base") + F.size("extra") > 0)
    spans = some.select("row_no", F.explode(F.concat("base", "extra")).alias("s")).select("row_no", "s", F.col("s.value").alias("value"))
    live = (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)
    is_base = F.col("s.kind") < len(KINDS)
    # The HOT_VALUES values of most repositories are broadcast; any other has at most a HOT_VALUES-th of all spans.
    hot = materialize(freq.orderBy(F.desc("n_repos"), "value").limit(hot_values), "hot-values")
    names = F.broadcast(hot.select("value"))
    rated = spans.join(F.broadcast(hot), "value").unionByName(spans.join(names, "value", "left_anti").join(freq, "value"))
    by_row = (
        rated.groupBy("row_no")
        .agg(
            F.count(F.when(is_base & live, 1)).alias("n_live"),
            F.count(F.when(is_base & ~live, 1)).alias("n_copied"),
            F.collect_list(F.when(~is_base & live, F.col("s"))).alias("more"),
        )
    )
    joined = found.join(by_row, "row_no", "left")
    clear = F.filter(
        F.coalesce("more", F.array().cast(_SPAN)),
        lambda s: ~F.exists("base", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])),
    )
    count = lambda no: F.size(F.filter("base", lambda s: s["kind"] == no)).cast("long")
    return joined.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", clear))).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
    )
