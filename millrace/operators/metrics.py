"""Counts, rates and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rate(part: Column, whole: Column) -> Column:
    """part / max(whole, 1)."""
    return part / F.greatest(whole, F.lit(1))


def distribution(df: DataFrame, value: Column, name: str = "value") -> DataFrame:
    """(value, n) for each value."""
    return df.groupBy(value.alias(name)).agg(F.count("*").alias("n"))


def split_stats(df: DataFrame, *by: str) -> DataFrame:
    """Rows, hateful rows and their percentage to one decimal."""
    h = F.coalesce(F.sum("hateful"), F.lit(0))
    return df.groupBy(*by).agg(F.count("*").alias("total"), h.cast("long").alias("hateful"), F.round(100.0 * h / F.greatest(F.count("*"), F.lit(1)), 1).alias("hateful_pct"))


def summary(score: str) -> list[Column]:
    """Mean and population deviation."""
    return [F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), F.count(score).alias("n")]


def majority(votes: Column, least: int = 2) -> Column:
    """Whether at least `least` votes are not zero."""
    return F.size(F.filter(votes, lambda x: x != 0)) >= least


def mode(votes: Column) -> Column:
    """The most frequent value; of several the one that comes first. Null for an empty array."""
    values = F.array_distinct(votes)
    counts = F.transform(values, lambda u: F.size(F.filter(votes, lambda x: x == u)))
    return F.when(F.size(values) > 0, F.get(values, (F.array_position(counts, F.array_max(counts)) - 1).cast("int")))


def dominant(df: DataFrame, by: str, reason: str, fallback: str) -> DataFrame:
    """(by, reason) with the most frequent reason that is not blank; of equally frequent ones the lexically last."""
    r = F.trim(F.coalesce(reason, F.lit("")))
    counts = df.withColumn("_r", r).groupBy(by, "_r").agg(F.count("*").alias("_n"))
    best = counts.groupBy(by).agg(F.max(F.when(F.col("_r") != "", F.struct("_n", "_r"))).alias("_best"))
    return best.select(by, F.coalesce(F.col("_best._r"), F.lit(fallback)).alias(reason))


def guarded(score: Column, collapse_rate: Column, most: float = 0.5) -> Column:
    """The score, or 0 if too many outputs are degenerate."""
    return F.when(collapse_rate >= most, F.lit(0.0)).otherwise(score)


def joint(sta: Column, sim: Column, clip: Column, precision: Column) -> Column:
    """The product of the four means; null if one is missing."""
    return sta * sim * clip * precision


def moving_average(df: DataFrame, series: list[str], order: str, value: str, window: Column | None = None) -> DataFrame:
    """(series, order, value) smoothed over `max(5, n div 20)` points; series of no more points stay as they are.

    Smoothed series have a value from the window's last point on. Each series is one of a trainer's logs and
    as short as that; a series is ordered in one task.
    """
    n = F.count("*").over(Window.partitionBy(*series))
    place = F.row_number().over(Window.partitionBy(*series).orderBy(order))
    w = F.greatest(F.lit(5), F.floor(n / 20)).cast("int") if window is None else window
    c = F.sum(value).over(Window.partitionBy(*series).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    d = df.withColumn("_n", n).withColumn("_w", w).withColumn("_i", place).withColumn("_c", c)
    before = d.select(*series, (F.col("_i") + F.col("_w")).alias("_i"), F.col("_c").alias("_b"))
    j = d.join(before, [*series, "_i"], "left")
    smooth = (F.col("_c") - F.coalesce("_b", F.lit(0.0))) / F.col("_w")
    return j.where((F.col("_n") <= F.col("_w")) | (F.col("_i") >= F.col("_w"))).select(*series, order, F.when(F.col("_n") <= F.col("_w"), F.col(value)).otherwise(smooth).alias(value))


def running(df: DataFrame, series: list[str], order: str, every: int, **sums: Column) -> DataFrame:
    """Running sums at every `every`-th row of each series."""
    w = Window.partitionBy(*series).orderBy(order)
    d = df.withColumn("seen", F.row_number().over(w).cast("long"))
    for name, c in sums.items():
        d = d.withColumn(name, F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.where(F.col("seen") % every == 0).select(*series, "seen", *sums)
