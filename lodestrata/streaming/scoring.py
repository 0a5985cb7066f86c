"""Scoring of arriving cells: the batch operators applied to each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def read_arriving(spark: SparkSession, path: str, schema: str, files: int = 8) -> DataFrame:
    """A stream of Parquet files as they arrive, some at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def apply_to_arriving(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Runs a batch operator over each micro-batch and stores its rows under the batch's number.

    A batch that is run again after a failure overwrites its own folder, so each row is stored once.
    """

    def store(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
