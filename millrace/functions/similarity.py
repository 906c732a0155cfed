"""Similarities that no SQL expression states, as Arrow functions; and word-overlap measures as expressions."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from millrace.functions.text import overlap


@F.pandas_udf(DoubleType())
def char_similarity(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Ratio of matching blocks (2 M / T) of two texts; null counts as empty."""
    for a, b in batches:
        yield pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def _lcs(a: list[str], b: list[str]) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            keep = row[j]
            row[j] = last + 1 if x == y else max(row[j], row[j - 1])
            last = keep
    return row[-1]


@F.pandas_udf(DoubleType())
def rouge_l(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """F-measure of the longest common subsequence of the words (space separated, unstemmed)."""
    for a, b in batches:
        out = []
        for x, y in zip(a, b, strict=True):
            p, q = (x or "").split(), (y or "").split()
            m = _lcs(p, q)
            out.append(2 * m / (len(p) + len(q)) if m else 0.0)
        yield pd.Series(out, dtype="float64")


def ngrams(words: Column, n: int) -> Column:
    """Runs of n words, joined by blanks; an empty array for fewer words."""
    if n == 1:
        return words
    last = F.size(words) - n
    runs = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(words, i + 1, F.lit(n)), " "))
    return F.when(last >= 0, runs).otherwise(F.array().cast("array<string>"))


def rouge_n(x: Column, y: Column) -> Column:
    """F-measure of the multiset overlap of two arrays of n-grams (unstemmed); 0 if either is empty."""
    return F.when((F.size(x) > 0) & (F.size(y) > 0), 2.0 * overlap(x, y) / (F.size(x) + F.size(y))).otherwise(F.lit(0.0))
