"""Record linkage of award rows to schools: block, score, guard, decide; then identities.

Scoring is the dear step, so names are first reduced to distinct keys, pairs exist only within
a municipality (and network, where known), and the costlier measures run on the three best raw
candidates alone. Blocks are equi-joins, so AQE splits large municipalities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEPENDENCY_WORDS, MEDALS, LinkRules
from ..functions import domain, similarity, text
from ..operators import joins, windows

KEY = ["olimpiada", "escola_norm", "co_municipio", "uf", "rede_grp"]
AWARD = ["olimpiada", "ano", "modalidade", "nivel", "medalha"]


def attach_city(df: DataFrame, cities: DataFrame, name: str, state: str, fuzzy: bool = True, least: float = 92.0, margin: float = 4.0) -> DataFrame:
    """Adds co_municipio and match_municipio: exato, fuzzy, ambiguo or sem_match.

    cities: co_municipio, no_municipio, uf. Fuzzy: same state, phonetic fold, ratio of at least
    ``least`` and ``margin`` above the runner-up; distinct names only are scored."""
    dim = cities.select("co_municipio", text.city_name(F.col("no_municipio")).alias("__k"), F.col("uf").alias("__uf"))
    keyed = df.withColumns({"__k": text.city_name(F.col(name)), "__uf": F.upper(F.trim(F.col(state)))})
    out = joins.match_unique(keyed, dim, ["__k", "__uf"], "co_municipio", "match_municipio")
    if not fuzzy:
        return out.drop("__k", "__uf")
    open_ = out.filter("match_municipio = 'sem_match' AND __k <> ''").select("__k", "__uf").distinct()
    near = dim.select(F.col("__uf"), F.col("__k").alias("__dim_k"), F.col("co_municipio").alias("__code"))
    pairs = open_.join(near, "__uf").withColumn("__score", similarity.ratio_col(text.phonetic_fold(F.col("__k")), text.phonetic_fold(F.col("__dim_k"))))
    best = windows.runner_up_margin(pairs, ["__k", "__uf"], "__score", "__code", "__margin")
    best = best.filter((F.col("__score") >= least) & (F.col("__margin") >= margin)).select("__k", "__uf", "__code")
    joined = out.join(best, ["__k", "__uf"], "left")
    hit = F.col("__code").isNotNull() & (F.col("match_municipio") == "sem_match")
    return joined.withColumns({
        "co_municipio": F.when(hit, F.col("__code")).otherwise(F.col("co_municipio")),
        "match_municipio": F.when(hit, "fuzzy").otherwise(F.col("match_municipio")),
    }).drop("__k", "__uf", "__code")


def with_row_ids(df: DataFrame, *order: str) -> DataFrame:
    """row_id: the row's place in a stated order (from 0), without one task for all rows.

    Rows are range-sorted; a partition's offset is the number of rows in those before it. The
    sorted rows are kept, as both readings of them must see the same partitions."""
    placed = df.repartitionByRange(*[F.col(c).asc_nulls_last() for c in order]).sortWithinPartitions(*[F.col(c).asc_nulls_last() for c in order])
    placed = placed.withColumn("__id", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__id", 33)).persist()
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    offsets = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    local = F.col("__id").bitwiseAND((1 << 33) - 1)
    return placed.join(offsets, "__part").select((F.col("__before") + local).alias("row_id"), *df.columns)


def prepare_awards(awards: DataFrame, cities: DataFrame) -> DataFrame:
    """Normalised names, municipality and network group of award rows that have row_id."""
    out = attach_city(awards, cities, "municipio_nome", "uf")
    return out.withColumns({
        "escola_norm": text.school_name(F.col("escola_nome")),
        "nome_norm": text.person_name(F.col("nome")),
        "rede_grp": domain.award_network(F.col("rede")),
    })


def _disjoint_words(a: Column, b: Column) -> Column:
    words = F.array(*[F.lit(w) for w in DEPENDENCY_WORDS])
    x, y = F.array_intersect(F.split(a, " "), words), F.array_intersect(F.split(b, " "), words)
    return (F.size(x) > 0) & (F.size(y) > 0) & ~F.arrays_overlap(x, y)


def candidates(keys: DataFrame, schools: DataFrame, rules: LinkRules = LinkRules()) -> DataFrame:
    """The ``top`` candidates of each key by raw score, guarded and ranked (1 best).

    keys: KEY; schools: co_entidade, no_escola, co_municipio, rede_publica."""
    dim = schools.select(
        "co_municipio", "co_entidade", "no_escola", "rede_publica", text.school_name(F.col("no_escola")).alias("norm")
    ).withColumn("core", text.name_core(F.col("norm")))
    group = F.col("rede_grp")
    fits = (group == "desconhecida") | (F.col("rede_publica") == (group == "publica")) if rules.use_network else F.lit(True)
    pairs = keys.filter("co_municipio IS NOT NULL AND escola_norm <> ''").join(dim, "co_municipio").filter(fits)
    pairs = pairs.withColumn("n_candidatos_mun", F.count(F.lit(1)).over(Window.partitionBy(*KEY)))
    scored = pairs.withColumn("raw", similarity.token_set_col("escola_norm", "norm"))
    few = windows.top_k(scored, KEY, max(rules.top, 3), F.col("raw").desc(), F.col("co_entidade"))
    few = few.withColumn("core_a", text.name_core(F.col("escola_norm")))
    la, lb = F.length("core_a"), F.length("core")
    ok = F.lit(True)
    if rules.subset_guard:
        few = few.withColumns({"sort": similarity.token_sort_col("core_a", "core"), "set": similarity.token_set_col("core_a", "core")})
        ok = (F.greatest(la, lb) > 0) & (F.col("sort") >= rules.core_sort) & (F.col("set") >= rules.core_set)
        ok = ok & (F.least(la, lb) >= rules.core_length * F.greatest(la, lb))
    if rules.dependency_guard:
        ok = ok & ~_disjoint_words(F.col("escola_norm"), F.col("norm"))
    if rules.number_guard:
        ok = ok & (text.number_tokens(F.col("escola_norm")) == text.number_tokens(F.col("norm")))
    few = few.withColumn("ok", ok).withColumn("second", similarity.ratio_col("escola_norm", "norm"))
    few = few.withColumn("score", F.when(F.col("ok") | (F.col("raw") < rules.auto), F.col("raw")).otherwise(rules.auto - 0.1))
    order = Window.partitionBy(*KEY).orderBy(F.desc("score"), F.desc("second"), F.desc("raw"), "co_entidade")
    return few.withColumn("place", F.row_number().over(order))


def link(keys: DataFrame, schools: DataFrame, rules: LinkRules = LinkRules()) -> DataFrame:
    """One row for each key: link_status auto, revisao or sem_match, its reason, score and candidates."""
    cands = candidates(keys, schools, rules)
    entry = F.struct("place", "score", "raw", "ok", "second", "co_entidade", "no_escola")
    per_key = cands.groupBy(*KEY).agg(F.array_sort(F.collect_list(entry)).alias("c"), F.max("n_candidatos_mun").alias("n_candidatos_mun"))
    joined = joins.null_safe(keys, per_key, KEY)
    best = F.try_element_at("c", F.lit(1))
    rivals = F.exists(
        F.slice("c", 2, 10),
        lambda x: (x["score"] >= rules.auto) & (best["score"] - x["score"] <= rules.tie) & (best["second"] - x["second"] <= rules.secondary_tie) & (x["co_entidade"] != best["co_entidade"]),
    )
    auto, review = best["score"] >= rules.auto, best["score"] >= rules.review
    found = F.col("c").isNotNull()
    in_city = keys.select("co_municipio", "rede_grp").distinct().join(schools.select("co_municipio", "rede_publica").distinct(), "co_municipio")
    group = F.col("rede_grp")
    fits = (group == "desconhecida") | (F.col("rede_publica") == (group == "publica")) if rules.use_network else F.lit(True)
    blocks = in_city.filter(fits).select("co_municipio", "rede_grp").distinct().withColumn("__block", F.lit(True))
    joined = joined.join(blocks, ["co_municipio", "rede_grp"], "left")
    reason = (
        F.when(F.col("co_municipio").isNull(), "sem_municipio")
        .when(F.col("__block").isNull(), "sem_candidato_no_municipio")
        .when(F.col("escola_norm") == "", "nome_vazio")
        .when(auto & rivals, "empate")
        .when(auto, None)
        .when(review & ~best["ok"] & (best["raw"] >= rules.auto), "guarda")
        .when(review, "score_intermediario")
        .otherwise("score_baixo")
    )
    status = F.when(found & auto & ~rivals, "auto").when(found & review, "revisao").otherwise("sem_match")
    shown = status != "sem_match"
    columns = {
        "link_status": status, "link_score": F.when(found, F.bround(best["score"], 1)),
        "co_entidade": F.when(shown, best["co_entidade"]), "no_escola_cand": F.when(shown, best["no_escola"]),
    }
    for n in (2, 3):
        other = F.try_element_at("c", F.lit(n))
        columns |= {f"cand{n}_co_entidade": F.when(shown, other["co_entidade"]), f"cand{n}_no_escola": F.when(shown, other["no_escola"]), f"cand{n}_score": F.when(shown, F.bround(other["score"], 1))}
    return joined.select(*KEY, *[c.alias(n) for n, c in columns.items()], reason.alias("motivo"), F.coalesce("n_candidatos_mun", F.lit(0)).cast("int").alias("n_candidatos_mun"))


def link_table(awards: DataFrame, schools: DataFrame, rules: LinkRules = LinkRules()) -> DataFrame:
    """Distinct keys with their rows and years, linked; every key comes out once."""
    keys = awards.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_linhas"), F.min("ano").alias("ano_min"), F.max("ano").alias("ano_max"))
    return joins.null_safe(link(keys.select(*KEY), schools, rules), keys, KEY)


def review_queue(links: DataFrame, cities: DataFrame) -> DataFrame:
    """Keys for people to decide, those with most rows first, with an empty column for the decision."""
    rows = links.filter("link_status = 'revisao'").join(cities.select("co_municipio", "no_municipio"), "co_municipio", "left")
    named = rows.select(
        "olimpiada", "uf", "co_municipio", F.col("no_municipio").alias("municipio"), F.col("escola_norm").alias("escola_medalhista_norm"),
        "rede_grp", "n_linhas", "motivo", F.col("co_entidade").alias("cand1_co_entidade"), F.col("no_escola_cand").alias("cand1_nome"),
        F.col("link_score").alias("cand1_score"),
        *[F.col(a).alias(b) for n in (2, 3) for a, b in ((f"cand{n}_co_entidade",) * 2, (f"cand{n}_no_escola", f"cand{n}_nome"), (f"cand{n}_score",) * 2)],
        F.lit("").alias("decisao_manual"),
    )
    return named.orderBy(F.desc("n_linhas"), "escola_medalhista_norm")


def link_rates(awards: DataFrame, links: DataFrame, by: list[str]) -> DataFrame:
    """Rows and percentages by status, rows without municipality apart."""
    joined = joins.null_safe(awards.select(*KEY, *[b for b in by if b not in KEY]), links.select(*KEY, "link_status", "motivo"), KEY)
    kind = F.when(F.col("motivo") == "sem_municipio", "sem_municipio").otherwise(F.col("link_status"))
    kinds = ("auto", "revisao", "sem_match", "sem_municipio")
    counted = joined.withColumn("cat", kind).groupBy(*by).agg(F.count("cat").alias("linhas"), *[F.count(F.when(F.col("cat") == k, 1)).alias(k) for k in kinds])
    return counted.select(*by, "linhas", *[F.bround(100.0 * F.col(k) / F.col("linhas"), 1).alias(f"pct_{k}") for k in kinds])


def enrich(awards: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(award rows with identity and totals, one row for each identity).

    awards: prepared rows with row_id. Only automatic links keep their school."""
    got = joins.null_safe(awards, links.select(*KEY, "link_status", "link_score", "co_entidade", "motivo"), KEY)
    got = got.withColumn("co_entidade", F.when(F.col("link_status") == "auto", F.col("co_entidade")))
    got = got.withColumn("escola_ref", F.coalesce("co_entidade", F.concat(F.lit("N:"), F.col("escola_norm"))))
    place = domain.place_key(F.col("co_municipio"), F.col("uf"))
    got = got.withColumn("aluno_key", similarity.blake2b_64(F.concat_ws("|", F.coalesce("nome_norm", F.lit("")), place, F.col("escola_ref"))))
    got = windows.duplicate_flag(got, ["aluno_key", *AWARD], "row_id")
    once = got.filter("NOT linha_duplicada")
    names = dict(zip(MEDALS, ("n_ouro", "n_prata", "n_bronze", "n_mencao")))
    totals = once.groupBy("aluno_key").agg(
        F.count(F.lit(1)).alias("n_premios"), F.countDistinct("olimpiada").alias("n_olimpiadas"), F.countDistinct("ano").alias("n_anos"),
        F.min("ano").alias("primeiro_ano"), F.max("ano").alias("ultimo_ano"), *[F.count(F.when(F.col("medalha") == m, 1)).alias(n) for m, n in names.items()],
    ).withColumn("n_medalhas", F.col("n_ouro") + F.col("n_prata") + F.col("n_bronze"))
    order = F.struct("ano", "row_id")
    first = lambda c: F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), order)).alias(c)
    people = got.groupBy("aluno_key").agg(*[first(c) for c in ("nome_norm", "co_municipio", "uf", "escola_norm", "escola_ref", "co_entidade", "link_status")])
    return got.join(totals, "aluno_key", "left"), people.join(totals, "aluno_key", "left")


def homonyms(awards: DataFrame, people: DataFrame) -> DataFrame:
    """Name and place groups with several schools; certo: awards of one year and level at several of them."""
    place = domain.place_key(F.col("co_municipio"), F.col("uf")).alias("lugar")
    groups = people.select("nome_norm", place, "aluno_key").groupBy("nome_norm", "lugar").agg(F.count(F.lit(1)).alias("n_escolas")).filter("n_escolas > 1")
    same = awards.select("nome_norm", place, "aluno_key", *AWARD[:-1]).groupBy("nome_norm", "lugar", *AWARD[:-1]).agg(F.countDistinct("aluno_key").alias("k"))
    certain = same.groupBy("nome_norm", "lugar").agg((F.max("k") > 1).alias("certo"))
    return groups.join(certain, ["nome_norm", "lugar"], "left")
