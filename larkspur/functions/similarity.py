"""Similarity of two keys: 100 * 2 * LCS / (length + length), LCS the longest common subsequence."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@lru_cache(maxsize=200_000)
def lcs_length(a: str, b: str) -> int:
    """Bit-parallel: one machine word of state per 64 characters of `a` (Hyyrö 2004)."""
    if len(a) < len(b):
        a, b = b, a
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    state = full = (1 << len(a)) - 1
    for c in b:
        met = state & places.get(c, 0)
        state = (state + met | state - met) & full
    return len(a) - state.bit_count()


def ratio_of(a: str, b: str) -> float:
    total = len(a) + len(b)
    return (1.0 - (total - 2 * lcs_length(a, b)) / total) * 100.0 if total else 100.0


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else ratio_of(x, y) for x, y in zip(a, b)], dtype="float64")


def ratio(a: Column, b: Column) -> Column:
    """Equal keys, and empty ones, do not reach Python."""
    easy = F.when(a == b, 100.0).when((a == "") | (b == ""), 0.0)
    return F.coalesce(easy, _ratio(F.when(easy.isNull(), a), F.when(easy.isNull(), b)))


def ratio_native(a: Column, b: Column) -> Column:
    """The same by higher-order functions: one row of the LCS table per character of `a`."""
    chars = F.filter(F.split(a, ""), lambda c: c != "")
    other = F.filter(F.split(b, ""), lambda c: c != "")
    zeros = F.array_repeat(F.lit(0), F.char_length(b) + 1)

    def row(prev: Column, c: Column) -> Column:
        step = lambda acc, j: F.concat(acc, F.array(F.when(F.get(other, j) == c, F.get(prev, j) + 1).otherwise(F.greatest(F.get(prev, j + 1), F.element_at(acc, -1)))))
        return F.aggregate(F.sequence(F.lit(0), F.char_length(b) - 1), F.array(F.lit(0)), step)

    lcs = F.element_at(F.aggregate(chars, zeros, row), -1)
    total = F.char_length(a) + F.char_length(b)
    return F.when(total == 0, 100.0).when((a == "") | (b == ""), 0.0).otherwise((1.0 - (total - 2 * lcs) / total) * 100.0)
