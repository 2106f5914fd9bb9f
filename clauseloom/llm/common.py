"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.plans.stage import stage

#: Bits of a 60-bit hash: fifteen hexadecimal digits of an MD5 sum, so that other SQL engines get the same number.
HASH_BITS = 60

#: Rows of whole texts that travel to Python at once.
TEXT_BATCH = "512"


def hash60(value: Column) -> Column:
    return F.conv(F.substring(F.md5(value.cast("string")), 1, 15), 16, 10).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python in batches of few rows, so that very long ones do not fill a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", TEXT_BATCH)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder with each row's ``place`` and a hash ``h2`` of it that parts even equal rows."""
    return stage(df.withColumn("place", F.monotonically_increasing_id()).withColumn("h2", hash60(F.col("place"))), name)


def fields(df: DataFrame) -> list[str]:
    """The columns of ``df`` as a schema string takes them."""
    return [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema]


def beside(batch: pa.RecordBatch, names: list[str], more: dict[str, object], rows: object = None) -> pa.RecordBatch:
    """The columns ``names`` of a batch, or of some of its ``rows``, with further ones. Nulls and types stay exact."""
    kept = batch.select(names)
    kept = kept if rows is None else kept.take(pa.array(rows))
    added = [x if isinstance(x, pa.Array) else pa.array(x) for x in more.values()]
    return pa.RecordBatch.from_arrays([*kept.columns, *added], names=[*names, *more])


def with_made(df: DataFrame, read: list[str], made: Callable[[], Callable], schema: str, drop: list[str]) -> DataFrame:
    """``df`` without ``drop`` and with the columns of ``schema``, which take the place of columns of the same name.

    ``made`` is called once per task and returns a function from lists of the values of ``read`` to those columns.
    """
    small_batches(df.sparkSession)
    new = {field.split()[0].lower() for field in schema.split(", ")}
    names = [c for c in df.columns if c not in drop and c.lower() not in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = made()
        for batch in batches:
            yield beside(batch, names, make(*[batch.column(c).to_pylist() for c in read]))

    return df.mapInArrow(run, ", ".join([*fields(df.select(*names)), schema]))
