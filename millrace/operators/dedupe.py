"""One row per key: first or last in a stated order. Never dropDuplicates, whose choice is not fixed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, key: Column, *order: Column | str) -> DataFrame:
    """The first row of each key. Rank filters on one row per key run as a group limit before the shuffle."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def last_wins(df: DataFrame, key: Column, *order: str) -> DataFrame:
    return first_wins(df, key, *[F.desc(c) for c in order])


def last_by(df: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """(key, values) of the last row of each key, by partial aggregation: for keys that hold many rows."""
    best = df.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_v"))
    return best.select(key, *[F.col(f"_v.{v}").alias(v) for v in values])


def first_by(df: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    best = df.groupBy(key).agg(F.min_by(F.struct(*values), F.struct(*order)).alias("_v"))
    return best.select(key, *[F.col(f"_v.{v}").alias(v) for v in values])
