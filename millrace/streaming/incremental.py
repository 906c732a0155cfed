"""Incremental runs: file streams that are read once, cleaned of repeats, and committed batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def json_stream(spark: SparkSession, path: str, schema: str, per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(path)


def first_arrivals(stream: DataFrame, key: str) -> DataFrame:
    """The first row that arrives for each key, over all batches."""
    return stream.dropDuplicates([key])


def run_once(stream: DataFrame, out: str, state: str, each: Callable[[DataFrame, int], DataFrame] | None = None) -> None:
    """Processes what is there and stops. Batches go to `out` whole or not at all; a restart takes up where `state` says.

    A batch that is repeated after a failure overwrites its own folder, so nothing is written twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        (each(batch, number) if each else batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
