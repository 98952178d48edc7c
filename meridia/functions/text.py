"""Text normalisation as column expressions: no Python runs on the executors."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import ABBREVIATIONS, GENERIC_WORDS, LEADING_ABBREVIATIONS, ROMAN, UPPER_SECONDARY_NAMES

#: Letters without a decomposition, and signs that stand for several ASCII characters.
_SPECIAL = {"ß": "ss", "ẞ": "SS", "Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "Þ": "Th", "þ": "th", "Ø": "O", "ø": "o",
            "Đ": "D", "đ": "d", "Ð": "D", "ð": "d", "Ł": "L", "ł": "l", "ı": "i", "º": "o", "ª": "a", "ŉ": "'n"}


def _fold_table() -> tuple[str, str]:
    """Single-letter folds of Latin letters, from their canonical decompositions."""
    source, target = "", ""
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFD", chr(code))[0]
        base = _SPECIAL.get(chr(code), base)
        if len(base) == 1 and base.isascii() and base != chr(code):
            source, target = source + chr(code), target + base
    for sign in "ºª":
        source, target = source + sign, target + _SPECIAL[sign]
    return source, target


_SOURCE, _TARGET = _fold_table()
#: Combining marks, deleted where a text comes decomposed.
_MARKS = "̀-ͯ"


def ascii_fold(c: Column) -> Column:
    """Latin letters without their accents; other characters stay."""
    out = F.translate(F.regexp_replace(c, f"[{_MARKS}]", ""), _SOURCE, _TARGET)
    for sign, text in _SPECIAL.items():
        if len(text) > 1:
            out = F.replace(out, F.lit(sign), F.lit(text))
    return out


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def base_text(c: Column) -> Column:
    """Upper case without accents; what is neither letter nor digit becomes one space; null becomes empty."""
    return squeeze(F.regexp_replace(F.upper(ascii_fold(F.coalesce(c.cast("string"), F.lit("")))), "[^A-Z0-9 ]+", " "))


def join_leading_letters(c: Column) -> Column:
    """Two or more single letters at the start become one word."""
    run = F.regexp_extract(c, r"^([A-Z](?: [A-Z])+)(?= |\z)", 1)
    return F.when(run != "", F.concat(F.replace(run, F.lit(" "), F.lit("")), F.substr(c, F.length(run) + 1))).otherwise(c)


def join_trailing_letters(c: Column) -> Column:
    """Two or more single letters at the end, after another word, become one word."""
    run = F.regexp_extract(c, r" ([A-Z](?: [A-Z])+)\z", 1)
    return F.when(run != "", F.concat(F.substr(c, F.lit(1), F.length(c) - F.length(run)), F.replace(run, F.lit(" "), F.lit("")))).otherwise(c)


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def expand_tokens(c: Column, table: dict[str, str] = ABBREVIATIONS, leading: dict[str, str] = LEADING_ABBREVIATIONS) -> Column:
    """Whole tokens replaced from the table; ``leading`` applies to the first token only."""
    full, first = _lookup(table), _lookup(leading)
    one = lambda t, i: F.coalesce(F.when(i == 0, F.try_element_at(first, t)), F.try_element_at(full, t), t)
    return F.array_join(F.transform(F.split(c, " "), one), " ")


def school_name(c: Column) -> Column:
    return squeeze(expand_tokens(join_trailing_letters(join_leading_letters(base_text(c)))))


def city_name(c: Column) -> Column:
    return squeeze(F.regexp_replace(base_text(c), r"\b(DE|DA|DO|DAS|DOS|D)\b", " "))


def person_name(c: Column) -> Column:
    return squeeze(F.regexp_replace(base_text(c), r"\b(DE|DA|DO|DAS|DOS|E)\b", " "))


def name_core(normal: Column) -> Column:
    """Of a normalised school name the tokens that tell schools apart; all, if none does."""
    generic = F.array(*[F.lit(w) for w in GENERIC_WORDS])
    core = F.filter(F.split(normal, " "), lambda t: ~F.array_contains(generic, t) & ~F.rlike(t, F.lit(r"\A[A-Z]\z")))
    return F.when(F.size(core) > 0, F.array_join(core, " ")).otherwise(normal)


def phonetic_fold(c: Column) -> Column:
    """Spellings that sound alike: Z-S, J-G, Y-I, K-C, W-V; H goes, repeats collapse."""
    return F.regexp_replace(F.replace(F.translate(c, "ZJYKWH", "SGICV"), F.lit("LL"), F.lit("L")), r"(.)\1+", "$1")


def number_tokens(c: Column) -> Column:
    """Sorted distinct tokens that are digits or Roman numerals from two on."""
    roman = F.array(*[F.lit(r) for r in ROMAN])
    return F.array_sort(F.array_distinct(F.filter(F.split(c, " "), lambda t: F.rlike(t, F.lit(r"\A[0-9]+\z")) | F.array_contains(roman, t))))


def digits_code(c: Column, width: int) -> Column:
    """Zero-filled code: text before the first point, digits only; null if none or too many."""
    digits = F.regexp_replace(F.split_part(c.cast("string"), F.lit("."), F.lit(1)), r"\D", "")
    return F.when(F.length(digits).between(1, width), F.lpad(digits, width, "0"))


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def padded(c: Column, width: int) -> Column:
    """Left zero fill that also cuts what is longer."""
    return F.lpad(blank_to_null(c), width, "0")


def full_match(c: Column, pattern: str) -> Column:
    return F.rlike(c, F.lit(rf"\A(?:{pattern})\z"))


def any_pattern(c: Column, patterns: tuple[str, ...] = UPPER_SECONDARY_NAMES) -> Column:
    """One alternation for a set of patterns, on the folded name."""
    return F.rlike(base_text(c), F.lit("|".join(f"(?:{p})" for p in patterns)))


def initials(c: Column) -> Column:
    """A.B. of the words of a name."""
    letters = F.transform(F.split(squeeze(c), " "), lambda t: F.upper(F.substring(t, 1, 1)))
    return F.when(F.length(F.trim(c)) > 0, F.concat(F.array_join(letters, "."), F.lit(".")))


def capitalised(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))


def split_state(c: Column, states: tuple[str, ...]) -> tuple[Column, Column]:
    """(city, state) of 'City - ST', 'City/ST' or 'City (ST)'; state null if the ending is no state."""
    pattern = r"^(.*?)[\s,/(-]+([A-Za-z]{2})\)?\s*$"
    state = F.upper(F.regexp_extract(c, pattern, 2))
    known = state.isin(*states)
    return F.when(known, F.trim(F.regexp_extract(c, pattern, 1))).otherwise(F.trim(c)), F.when(known, state)


def not_available_to_number(c: Column) -> Column:
    """Numbers of published sheets: trailing asterisks go, the decimal comma becomes a point."""
    return F.replace(F.regexp_replace(F.trim(c), r"\*+\z", ""), F.lit(","), F.lit(".")).try_cast("double")
