"""Raw annotation sources as records of one schema (`schemas.UNIFIED` without the split): lines, a table, a map document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.keys import stem
from millrace.operators.metrics import mode as most_frequent
from millrace.sources import readers

#: The label that stands for harmless ones in lines, and the names of the codes in map documents.
HARMLESS = "not harmful"
CODES = ("NotHate", "Racist", "Sexist", "Homophobe", "Religion", "OtherHate")


def first_label(labels: Column) -> Column:
    """The label of a field that holds a JSON list of labels (its first one counts) or one alone; a missing field is harmless."""
    listed = F.get(F.from_json(labels, "array<string>"), 0)
    return F.coalesce(F.when(F.startswith(labels, F.lit("[")), listed).otherwise(labels), F.lit(HARMLESS))


def from_lines(spark: SparkSession, path: str | list[str], images: str, dataset: str) -> DataFrame:
    """JSON lines with `image`, `text`, `labels` (a list or a scalar) and maybe `id`, which else is the picture's stem."""
    raw = readers.jsonl(spark, path, "id string, image string, text string, labels string")
    image, label = F.coalesce("image", F.lit("")), first_label(F.col("labels"))
    return raw.select(
        F.coalesce("id", stem(image)).alias("id"), F.concat_ws("/", F.lit(images), image).alias("image_path"), F.lit(dataset).alias("dataset"),
        F.coalesce("text", F.lit("")).alias("text"), (F.lower(label) != HARMLESS).cast("int").alias("hateful"), label.alias("original_label"),
    )


def from_table(table: DataFrame, images: str, dataset: str) -> DataFrame:
    """A table of strings whose columns are found by parts of their names: a file, a 0/1 label, a text. Without a file or label column there are no rows."""
    file, label, text = readers.fuzzy(table, "file"), readers.fuzzy(table, "misogyn"), readers.fuzzy(table, "text", "transcri")
    if file is None or label is None:
        return table.sparkSession.createDataFrame([], "id string, image_path string, dataset string, text string, hateful int, original_label string")
    name, value = F.trim(F.col(file)), F.col(label).try_cast("int")
    return table.select(
        stem(name).alias("id"), F.concat_ws("/", F.lit(images), name).alias("image_path"), F.lit(dataset).alias("dataset"),
        (F.trim(F.coalesce(F.col(text), F.lit(""))) if text else F.lit("")).alias("text"),
        F.coalesce((value == 1).cast("int"), F.lit(0)).alias("hateful"), F.concat(F.lit("misogynous="), F.coalesce(value.cast("string"), F.lit("unknown"))).alias("original_label"),
    )


def from_map(entries: DataFrame, listing: DataFrame, dataset: str) -> DataFrame:
    """(key, value) of a map document with three votes each; entries whose picture isn't in the listing (stem, path) are left out.

    Hateful are entries with two votes or more that are not 0. The label is the most frequent of these votes.
    """
    votes = F.coalesce("value.labels", F.array(*[F.lit(0)] * 3))
    cast = F.filter(votes, lambda x: x != 0)
    code = most_frequent(cast)
    label = F.when(F.size(cast) == 0, F.lit(CODES[0])).otherwise(F.coalesce(F.get(F.array(*map(F.lit, CODES)), code), code.cast("string")))
    return entries.join(listing.select(F.col("stem").alias("key"), F.col("path").alias("image_path")), "key").select(
        F.col("key").alias("id"), "image_path", F.lit(dataset).alias("dataset"), F.coalesce("value.tweet_text", F.lit("")).alias("text"),
        (F.size(cast) >= 2).cast("int").alias("hateful"), label.alias("original_label"),
    )
