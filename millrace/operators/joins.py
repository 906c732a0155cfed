"""Joins that the pipeline names: kept rows, rows still to do, lookups by two keys, positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.dedupe import first_by, last_by
from millrace.session import stored


def keep(df: DataFrame, allowed: DataFrame | None, on: str) -> DataFrame:
    """Rows whose key is listed; without a list all rows pass."""
    return df if allowed is None else df.join(allowed.select(on).distinct(), on, "left_semi")


def pending(df: DataFrame, done: DataFrame, on: str) -> DataFrame:
    """Rows whose key is not among the done ones; null keys are never done."""
    return df.join(done.select(on).where(F.col(on).isNotNull()).distinct(), on, "left_anti")


def two_level(df: DataFrame, source: DataFrame, scope: str, key: str, order: list[str], value: str, missing: str | None = "") -> DataFrame:
    """`value` looked up by (scope, key), where the last row counts, then by key alone, where the first one does.

    A miss gives `missing`, or drops the row if that is None.
    """
    scoped = last_by(source.withColumn("_k", F.concat_ws("::", scope, key)), "_k", order, [value]).withColumnRenamed(value, "_scoped")
    plain = first_by(source, key, order, [value]).withColumnRenamed(value, "_plain")
    j = df.withColumn("_k", F.concat_ws("::", scope, key)).join(scoped, "_k", "left").join(plain, key, "left")
    out = j.withColumn(value, F.coalesce("_scoped", "_plain")).drop("_k", "_scoped", "_plain")
    return out.where(F.col(value).isNotNull()) if missing is None else out.fillna(missing, [value])


def numbered(df: DataFrame, partition: list[str], *order: str, name: str = "place") -> DataFrame:
    """Rows numbered from 0 within `partition` (null is one of its values), in the order of the columns named.

    Rows are dealt to ranges of (partition, order), numbered inside them, and the counts of the ranges before are added,
    so a partition that holds most rows is numbered by many tasks.
    """
    ranged = stored(df.repartitionByRange(*partition, *order).withColumn("_r", F.spark_partition_id()))
    w = Window.partitionBy(*partition).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(*partition, "_r").agg(F.count("*").alias("_c"))  # as many rows as there are ranges, and partitions that share one
    before = counts.select(*[F.col(c).alias(f"_s{i}") for i, c in enumerate(partition)], F.col("_r").alias("_q"), F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_before"))
    on = ranged["_r"] == before["_q"]
    for i, c in enumerate(partition):
        on = on & ranged[c].eqNullSafe(before[f"_s{i}"])
    place = F.row_number().over(Window.partitionBy(*partition, "_r").orderBy(*order)) - 1
    return ranged.withColumn("_p", place).join(before, on).withColumn(name, (F.col("_p") + F.col("_before")).cast("long")).select(*df.columns, name)
