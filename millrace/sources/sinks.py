"""Writers, and a place for files that a query writes and reads again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import kept_until_release


def scratch(spark: SparkSession, name: str) -> str:
    """The path of a new folder in the shared place that the cluster names; `session.release` deletes it."""
    return kept_until_release(spark, name)


def csv_table(df: DataFrame, path: str, columns: list[str], single: bool = False) -> None:
    """The listed columns with a header; others are left out."""
    out = df.select(*columns)
    (out.coalesce(1) if single else out).write.mode("overwrite").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One object per line, nulls written. `append` adds files and leaves the others alone; `ignore` keeps what is there."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def document(*columns: Column) -> Column:
    """One row as a JSON document with nulls."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def fixed_width(*cells: tuple[Column, int]) -> Column:
    """A line of a text report: each cell padded to its width."""
    return F.concat(*[F.rpad(F.coalesce(c.cast("string"), F.lit("N/A")), w, " ") for c, w in cells])


def copy_plan(df: DataFrame, path: Column, folder: str, *parts: Column) -> DataFrame:
    """(src, dst): where sampled files go; copying them is left to the caller."""
    return df.select(path.alias("src"), F.concat_ws("/", F.lit(folder), *parts, F.regexp_extract(path, r"([^/\\]+)$", 1)).alias("dst"))
