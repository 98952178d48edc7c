"""String similarities on the scale 0 to 100, as Arrow-batched functions.

ratio is 200 * LCS / (len a + len b) (insertions and deletions alone), by a bit-parallel LCS on
Python's long integers; Spark's levenshtein is another measure. token_sort compares sorted
tokens; token_set the common tokens with either side's rest, and is 100 where one set contains
the other."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs(a: str, b: str) -> int:
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    open_ = full
    for ch in b:
        hit = open_ & where.get(ch, 0)
        open_ = ((open_ + hit) | (open_ - hit)) & full
    return len(a) - open_.bit_count()


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 if total == 0 else 200.0 * lcs(a, b) / total


@lru_cache(maxsize=1 << 16)
def _tokens(s: str) -> tuple[str, ...]:
    return tuple(sorted(s.split()))


def token_sort(a: str, b: str) -> float:
    return ratio(" ".join(_tokens(a)), " ".join(_tokens(b)))


def token_set(a: str, b: str) -> float:
    sa, sb = set(_tokens(a)), set(_tokens(b))
    if not sa or not sb:
        return 0.0
    common, only_a, only_b = " ".join(sorted(sa & sb)), " ".join(sorted(sa - sb)), " ".join(sorted(sb - sa))
    if common and (not only_a or not only_b):
        return 100.0
    with_a, with_b = len(common) + bool(common) + len(only_a), len(common) + bool(common) + len(only_b)
    distance = len(only_a) + len(only_b) - 2 * lcs(only_a, only_b)
    best = 100.0 - 100.0 * distance / (with_a + with_b)
    if common:
        best = max(best, *(100.0 - 100.0 * (1 + len(rest)) / (2 * len(common) + 1 + len(rest)) for rest in (only_a, only_b)))
    return best


def _pandas(measure):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else measure(x, y) for x, y in zip(a, b)], dtype="float64")

    return F.pandas_udf(run, T.DoubleType())


ratio_col = _pandas(ratio)
token_sort_col = _pandas(token_sort)
token_set_col = _pandas(token_set)


@F.pandas_udf(T.StringType())
def blake2b_64(s: pd.Series) -> pd.Series:
    """16 hex digits of BLAKE2b, which Spark has no function for."""
    return s.map(lambda x: None if x is None else hashlib.blake2b(x.encode(), digest_size=8).hexdigest())
