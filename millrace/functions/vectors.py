"""Expressions over arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def doubles(a: Column) -> Column:
    return a.cast("array<double>")


def softmax(a: Column) -> Column:
    """Exponentials over their sum, shifted by the maximum."""
    e = F.transform(a, lambda x: F.exp(x - F.array_max(a)))
    return F.transform(e, lambda x: x / total(e))


def argmax(a: Column) -> Column:
    """0-based place of the first maximum."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


def cosine01(a: Column, b: Column) -> Column:
    """(cosine + 1) / 2; null for a zero vector."""
    d = norm(a) * norm(b)
    return F.when(d > 0, (dot(a, b) / d + 1) / 2)


def padded(a: Column, n: int) -> Column:
    """Zeros after the values up to n; longer vectors are cut."""
    return F.slice(F.concat(a, F.array_repeat(F.lit(0.0), n)), 1, n)


def mean_pool(a: Column, width: int) -> Column:
    """Means of consecutive groups of `width` values."""
    n = F.floor(F.size(a) / width).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: total(F.slice(a, i * width + 1, F.lit(width))) / width)


def mse(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))) / F.size(a)


def probability(scores: Column, positive: Column) -> Column:
    """A score vector as the probability of its positive class.

    One value passes if it already lies in [0, 1], else goes through the logistic function. Several pass if
    they sum to 1 within 0.001, else go through softmax; the index is clamped. The tests are made row by row.
    """
    one = F.element_at(scores, 1)
    alone = F.when((one >= 0) & (one <= 1), one).otherwise(1 / (1 + F.exp(-one)))
    at = F.greatest(F.lit(0), F.least(positive, F.size(scores) - 1)) + 1
    many = F.when(F.abs(total(scores) - 1) <= 1e-3, F.element_at(scores, at)).otherwise(F.element_at(softmax(scores), at))
    return F.when(F.size(scores) == 1, alone).when(F.size(scores) > 1, many)
