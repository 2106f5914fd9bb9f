"""What both vector searches share: which vectors take part, how blocks meet, and the best of all blocks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Blocks whose results are merged at once.
FAN_IN = 64


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``vec_id`` and ``v`` (doubles) of rows with an id and a vector of finite numbers.

    If vectors differ in length, those of the length that most rows have take part, of two such lengths the greater.
    """
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).filter(fine)
    lengths = rows.groupBy(F.size("v").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    usual = lengths.agg(F.max(F.struct("n", "length"))["length"]).first()[0] or 0
    return rows.filter(F.size("v") == usual)


def matrix(column: pd.Series, dtype: type = np.float64) -> np.ndarray:
    """Rows of numbers from a column of their bytes."""
    return np.frombuffer(b"".join(column), dtype).reshape(len(column), -1)


def block_of(key: Column, blocks: Column | int, salt: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(blocks) if isinstance(blocks, int) else blocks).cast("int")


def meet(vectors: DataFrame, queries: DataFrame, on: list[str], search: Callable, schema: str) -> DataFrame:
    """Every block of vectors with every block of queries that has its key; ``search`` gets two bounded frames."""
    return vectors.groupBy(*on).cogroup(queries.groupBy(*on)).applyInPandas(search, schema)


def best(found: DataFrame, k: int, blocks: int, group: str = "block") -> DataFrame:
    """The ``k`` best rows (query_id, vec_id, score) of each query with their rank, ties to the smaller id.

    Blocks are merged ``FAN_IN`` at a time, so no query ever has more than ``FAN_IN * k`` rows in one place.
    """
    order = (F.desc("score"), F.asc("vec_id"))
    while blocks > 1:
        blocks = -(-blocks // FAN_IN)
        found = found.withColumn(group, F.floor(F.col(group) / FAN_IN).cast("int"))
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", group).orderBy(*order)))
        found = ranked.filter(F.col("rank") <= k).drop("rank")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= k)
