"""Run a stream over what has arrived, into the shared folder."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clauseloom.plans.stage import fresh_path


def drain(stream: DataFrame, name: str, mode: str = "append", path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Process all available input and return the rows written. Append mode only."""
    spark = stream.sparkSession
    path = path or fresh_path(spark, name)
    query = (
        stream.writeStream.outputMode(mode).format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint or fresh_path(spark, f"{name}-checkpoint"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def for_each_batch(
    stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"
) -> None:
    """Process all available input through ``write(batch, batch_id)``, which must be safe to repeat."""
    query = (
        stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def for_each_commit(stream: DataFrame, write: Callable[[DataFrame, int, str], None], checkpoint: str, mode: str = "append") -> None:
    """Like :func:`for_each_batch` with the stream's id, ``write(batch, batch_id, stream_id)``.

    The id is kept in the checkpoint, so (stream, batch) names a batch once and for all: a stream that starts over with another
    checkpoint numbers its batches from 0 again but has another id.
    """
    known, named = threading.Event(), {}

    def run(batch: DataFrame, batch_id: int) -> None:
        known.wait()
        write(batch, batch_id, named["id"])

    query = (
        stream.writeStream.outputMode(mode).foreachBatch(run).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    named["id"] = str(query.id)
    known.set()
    query.awaitTermination()


def write_batches(stream: DataFrame, name: str, mode: str, checkpoint: str | None = None, path: str | None = None) -> DataFrame:
    """Write each batch to its own ``batch_id`` folder. A repeated batch replaces its folder."""
    spark = stream.sparkSession
    path = path or fresh_path(spark, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    for_each_batch(stream, write, checkpoint or fresh_path(spark, f"{name}-checkpoint"), mode)
    return spark.read.schema(stream.schema.add("batch_id", "long")).parquet(path)


def file_stream(spark: SparkSession, folder: str, name: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files named ``name`` in a folder as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)
