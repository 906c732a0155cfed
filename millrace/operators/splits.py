"""Splits and samples by a seeded hash order: the same rows on every run, engine and cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.keys import seeded


#: Rows that one task ranks, about.
RANKED = 1_000_000


def range_digits(n: int, ranked: int = RANKED) -> int:
    """Hex digits of the order that make a range, so that n rows are ranked in parts of about `ranked`; two at least."""
    digits = 2
    while n > ranked * 16**digits:
        digits += 1
    return digits


def hash_ranked(df: DataFrame, strata: list[str], key: str, seed: int) -> DataFrame:
    """Adds `n_` (rows of the stratum) and `rank_` (from 1, in seeded hash order).

    Rows are ranked inside ranges of the hash, and the counts of the ranges before are added, so a stratum that
    holds most of the rows is still ranked by many tasks. Null strata are strata of their own.
    """
    h = df.withColumn("_h", seeded(F.col(key), seed)).withColumn("_r", F.substring("_h", 1, range_digits(df.count())))
    w = Window.partitionBy(*strata).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    counts = h.groupBy(*strata, "_r").agg(F.count("*").alias("_c"))  # a row per range and stratum
    counts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(w), F.lit(0))).withColumn("n_", F.sum("_c").over(Window.partitionBy(*strata))).drop("_c")
    counts = counts.select(*[F.col(c).alias(f"_s{i}") for i, c in enumerate(strata)], F.col("_r").alias("_q"), "_before", "n_")
    on = F.col("_r") == F.col("_q")
    for i, c in enumerate(strata):
        on = on & h[c].eqNullSafe(F.col(f"_s{i}"))
    rank = F.row_number().over(Window.partitionBy(*strata, "_r").orderBy("_h", key))
    out = h.withColumn("_place", rank).join(counts, on).withColumn("rank_", F.col("_place") + F.col("_before"))
    return out.drop("_h", "_r", "_q", "_place", "_before", *[f"_s{i}" for i in range(len(strata))])


def stratified(df: DataFrame, strata: list[str], key: str, train: float = 0.8, val: float = 0.1, seed: int = 42) -> DataFrame:
    """Adds `split`: within each stratum max(1, round half even(val n)) rows of val, the same of the rest for test, train else.

    Rows are ranked in hash order. A stratum of one row goes to test, of two to val and test.
    """
    d = hash_ranked(df, strata, key, seed)
    n, r = F.col("n_").cast("double"), F.col("rank_").cast("double")
    n_val = F.greatest(F.lit(1.0), F.rint(n * F.lit(val)))
    n_test = F.greatest(F.lit(1.0), F.rint(n * F.lit(1 - train - val)))
    n_train = F.greatest(n - n_val - n_test, F.lit(0.0))
    split = F.when(r <= n_train, F.lit("train")).when(r <= F.greatest(n - n_test, F.lit(0.0)), F.lit("val")).otherwise(F.lit("test"))
    return d.withColumn("split", split).drop("n_", "rank_")


def two_way(df: DataFrame, key: str, ratio: float = 0.9, seed: int = 42) -> DataFrame:
    """Adds `split`: train for floor(n ratio) rows, val for the others, in hash order.

    The cut is found on hash ranges: ranges before it are train as a whole, only the one that holds it is
    ranked, so no task sorts the table.
    """
    spark = df.sparkSession
    h = df.withColumn("_h", seeded(F.col(key), seed)).withColumn("_r", F.substring("_h", 1, 3))
    counts = sorted((r["_r"], r["count"]) for r in h.groupBy("_r").count().collect())  # at most 4,096 ranges
    n = sum(c for _, c in counts)
    room, rows = int(n * ratio), []
    for r, c in counts:
        rows.append((r, max(0, min(c, room)), c))
        room -= c
    if not rows:
        return df.withColumn("split", F.lit(None).cast("string"))
    cuts = F.broadcast(spark.createDataFrame(rows, "_r string, _room bigint, _n bigint"))
    j = h.join(cuts, "_r")
    whole = j.where("_room = 0 or _room = _n").withColumn("split", F.when(F.col("_room") > 0, "train").otherwise("val"))
    rank = F.row_number().over(Window.partitionBy("_r").orderBy("_h", key))
    part = j.where("_room > 0 and _room < _n").withColumn("split", F.when(rank <= F.col("_room"), "train").otherwise("val"))
    return whole.unionByName(part).drop("_h", "_r", "_room", "_n")


def per_class(df: DataFrame, classes: list[str], key: str, k: int, seed: int = 0) -> DataFrame:
    """min(k, n) rows of each class in hash order, by a group limit before the shuffle."""
    w = Window.partitionBy(*classes).orderBy(seeded(F.col(key), seed), key)
    return df.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= k).drop("_place")


def top(df: DataFrame, k: int, *order) -> DataFrame:
    return df.orderBy(*order).limit(k)
