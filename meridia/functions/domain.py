"""Domain rules as column expressions: networks, stages, income, eligibility, award identity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config
from .text import any_pattern, initials


def _case(c: Column, table: dict, part: int) -> Column:
    out = F.lit(None).cast("string")
    for code, pair in table.items():
        out = F.when(c == F.lit(code), F.lit(pair[part]).cast("string")).otherwise(out)
    return out


def network(c: Column, source: str) -> tuple[Column, Column]:
    """(group, detail) of a network code; both null if unknown."""
    table = config.NETWORK_MAPS[source]
    return _case(c, table, 0), _case(c, table, 1)


def exam_network(dependency: Column, self_report: Column) -> tuple[Column, Column]:
    """The administrative code first, then what participants report."""
    dep, own = network(dependency, "exam_dependency"), network(self_report, "exam_self_report")
    return F.coalesce(dep[0], own[0]), F.when(dependency.isNotNull(), dep[1]).otherwise(own[1])


def award_network(c: Column) -> Column:
    """publica, privada or desconhecida."""
    return F.coalesce(network(c, "awards")[0], F.lit("desconhecida"))


def stage(competition: Column, modality: Column, level: Column) -> Column:
    """School stage of an award; null if no rule has it. Modality null is empty, its edition prefix is cut."""
    plain = F.replace(F.coalesce(modality, F.lit("")), F.lit(config.MODALITY_PREFIX), F.lit(""))
    out = F.lit(None).cast("string")
    for comp, mod, lev, result in config.STAGE_RULES:
        rule = [competition == comp] + ([plain == mod] if mod is not None else []) + ([level.cast("string") == lev] if lev is not None else [])
        out = F.when(reduce(lambda a, b: a & b, rule), result).otherwise(out)
    return out


def in_scope(stage_: Column) -> Column:
    return F.coalesce(stage_.isin(*config.IN_SCOPE), F.lit(False))


def is_upper_secondary(stage_: Column, school: Column) -> Column:
    """By stage; awards of mixed stage by the school's name."""
    mixed = (stage_ == config.MIXED_STAGE) & any_pattern(school)
    return F.coalesce(stage_.isin(*config.UPPER_SECONDARY) | mixed, F.lit(False))


def eligible(upper_secondary: Column, year: Column, current_year: int) -> Column:
    """Upper-secondary awards count in their year and the next; others always."""
    return ~upper_secondary | (year >= current_year - 1)


def completes_school(code: Column) -> Column:
    return code.isin(*config.COMPLETION_CODES)


def per_head(amount: Column, people: Column) -> Column:
    return F.try_divide(amount.cast("double"), people.cast("double"))


def income_class(low: Column, high: Column, people: Column, limit: float = config.LOW_INCOME) -> Column:
    """certamente_le, acima or possivelmente, from a band's limits per head."""
    certain = high.isNotNull() & (per_head(high, people) <= limit)
    return F.when(certain, "certamente_le").when(per_head(low, people) >= limit, "acima").otherwise("possivelmente")


def minimum_wage(year: Column) -> Column:
    out = F.lit(None).cast("double")
    for y, amount in config.MINIMUM_WAGE.items():
        out = F.when(year == y, amount).otherwise(out)
    return out


def valid_score(c: Column, zero_ok: bool = False, top: float = 1000.0) -> Column:
    """Null outside the scale; objective scores are never zero, essays may be."""
    ok = c.between(0, top) if zero_ok else (c > 0) & (c <= top)
    return F.when(ok, c)


def zero_count(*scores: Column) -> Column:
    """Number of zeros among the scores; null as soon as one score is null."""
    return reduce(lambda a, b: a + b, [(s == 0).cast("int") for s in scores])


def text_part(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def salted_hash(salt: str, *parts: Column) -> Column:
    """SHA-256 over salt and parts, joined by |; null parts are empty."""
    if len(salt) < 32:
        raise ValueError("the salt must have 32 characters at least")
    return F.sha2(F.concat_ws("|", F.lit(salt), *map(text_part, parts)), 256)


def pseudonym(salt: str, name: Column, *parts: Column) -> Column:
    """Initials and six hex digits."""
    return F.concat_ws("#", F.coalesce(initials(name), F.lit("")), F.upper(F.substring(salted_hash(salt, name, *parts), 1, 6)))


def place_key(city_code: Column, state: Column) -> Column:
    return F.coalesce(city_code, F.concat(F.lit("UF:"), F.coalesce(state, F.lit(""))))


def sha1_identity(*parts: Column) -> Column:
    """16 hex digits of SHA-1 over the parts."""
    return F.substring(F.sha1(F.concat_ws("|", *map(text_part, parts)).cast("binary")), 1, 16)
