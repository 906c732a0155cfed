"""Scans of CSV, JSON and directories with the pipeline's rules for bad input."""

from __future__ import annotations

import csv
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from millrace import schemas
from millrace.functions.keys import stem

PICTURES = ("jpg", "jpeg", "png", "JPG", "PNG")


def csv_table(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """CSV with a header, embedded line breaks and doubled quotes. Empty cells are null, `NA` is text."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest with `kept` as a boolean; a missing file is an empty one."""
    found = _exists(spark, path)
    df = csv_table(spark, path, schemas.MANIFEST) if found else spark.createDataFrame([], schemas.MANIFEST)
    return df.withColumn("kept", F.coalesce(F.lower(F.trim("kept")).isin("true", "1"), F.lit(False)))


def sniffed(spark: SparkSession, path: str, columns: str | None = None) -> DataFrame:
    """A table whose delimiter is the one its first line has most of; quotes are ordinary characters; torn rows are left out.

    Only the first line comes to the driver. All columns are strings, named by the header in normal form.
    """
    first = spark.read.text(path).limit(1).collect()
    line = first[0][0] if first else ""
    try:
        sep = csv.Sniffer().sniff(line, delimiters=",;\t|").delimiter
    except csv.Error:
        sep = max("\t,;|", key=line.count)
    names = [normal_name(c) for c in line.split(sep)]
    schema = columns or ", ".join(f"`{n}` string" for n in names)
    return spark.read.schema(schema).option("header", True).option("sep", sep).option("quote", "").option("mode", "DROPMALFORMED").csv(path)


def normal_name(name: str) -> str:
    return name.strip().lower().replace(" ", "_")


def fuzzy(df: DataFrame, *parts: str) -> str | None:
    """The first column whose name contains one of the parts, tried in order of the parts."""
    return next((c for p in parts for c in df.columns if p in c), None)


def jsonl(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Strict scan: a bad line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def numbered_lines(spark: SparkSession, path: str | list[str], pattern: str = "*") -> DataFrame:
    """(file, line, value): lines numbered from 1 in each file. A file is read by one task."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    return raw.select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line", "value")).withColumn("line", F.col("line") + 1)


def json_state(value: Column) -> Column:
    """blank, object, invalid: what a line holds. Arrays, scalars and torn lines are invalid."""
    text = F.trim(F.regexp_replace(value, r"[\s]+", " "))
    return F.when(text == "", "blank").when(text.startswith("{") & F.from_json(value, "map<string,string>").isNotNull(), "object").otherwise("invalid")


def permissive(lines: DataFrame, schema: str) -> DataFrame:
    """(file, line, state, record) of numbered lines; the record of a bad line is null."""
    s = json_state(F.col("value"))
    return lines.select("file", "line", s.alias("state"), F.when(s == "object", F.from_json("value", schema)).alias("record"))


def until_bad(lines: DataFrame, schema: str) -> DataFrame:
    """The records before the first bad line of each file, as a reader that stops there would have them."""
    p = permissive(lines, schema)
    bad = p.where("state = 'invalid'").groupBy("file").agg(F.min("line").alias("stop"))
    return p.where("state = 'object'").join(bad, "file", "left").where("stop is null or line < stop").drop("stop")


def json_map(spark: SparkSession, path: str, schema: str = schemas.TWEETS, whole: bool = True) -> DataFrame:
    """(key, value) of JSON objects that map keys to records: one per file, or (not `whole`) one per line."""
    doc = spark.read.text(path, wholetext=whole).select(F.from_json("value", schema).alias("m"))
    return doc.select(F.explode("m").alias("key", "value"))


def json_directory(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A record per `*.json` file, with the file's name as `key`."""
    df = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
    return df.select(stem(F.col("_metadata.file_name")).alias("key"), *df.columns)


def files(spark: SparkSession, path: str, *extensions: str) -> DataFrame:
    """(path, name, stem, size) of the files below a directory; contents aren't read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{{{','.join(extensions or PICTURES)}}}").load(path)
    return df.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), stem(F.col("path")).alias("stem"), F.col("length").alias("size"))


def preferred(listing: DataFrame, order: tuple[str, ...] = ("jpg", "jpeg", "png")) -> DataFrame:
    """One file per stem: the extension that comes first in `order`."""
    ext = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    place = F.array_position(F.array(*[F.lit(e) for e in order]), ext)
    return listing.where(place > 0).groupBy("stem").agg(F.min_by("name", F.struct(place, F.col("name"))).alias("name"))


def latest_checkpoint(listing: DataFrame) -> DataFrame:
    """(run, path): of paths `run/checkpoint-N/...` the one with the highest number; a path without one comes first."""
    n = F.regexp_extract("path", r"checkpoint-(\d+)", 1).try_cast("int")
    return listing.groupBy("run").agg(F.max_by("path", F.struct(n.isNull(), F.coalesce(n, F.lit(0)), F.col("path"))).alias("path"))


def annotation_file(names: list[str]) -> str | None:
    """The first name in order that contains `train`, else the first, among tables; None if there is none."""
    tables = sorted(n for n in names if n.lower().endswith((".csv", ".xlsx", ".xls", ".tsv")))
    return next((n for n in tables if "train" in n.lower()), tables[0] if tables else None)


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    """The first of the paths that is there; if none is, the first."""
    return next((p for p in paths if _exists(spark, p)), paths[0] if paths else None)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(conf).globStatus(p))


class SpreadsheetSource(DataSource):
    """`spark.read.format("spreadsheet").option("path", …)`: a sheet's cells as strings. Needs a reader that pandas supports."""

    @classmethod
    def name(cls) -> str:
        return "spreadsheet"

    def schema(self) -> str:
        return ", ".join(f"`{normal_name(str(c))}` string" for c in self._frame(0).columns)

    def _frame(self, rows: int | None = None):
        import pandas as pd

        return pd.read_excel(self.options["path"], dtype=str, nrows=rows)

    def reader(self, schema) -> DataSourceReader:
        outer = self

        class Reader(DataSourceReader):
            def read(self, partition) -> Iterator[tuple]:
                for row in outer._frame().itertuples(index=False):
                    yield tuple(None if isinstance(x, float) else x for x in row)

        return Reader()
