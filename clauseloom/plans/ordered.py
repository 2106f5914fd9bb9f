"""Ordered computations that stay split when one key holds most of the rows.

A window over a document sends the whole document to one task. Here each key is cut into segments of
a fixed number of positions, the window runs inside a segment, and only one small row per segment
goes through a window over the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.plans.stage import stage

#: Positions per segment. A window or an array never holds more rows than this.
SEGMENT_ROWS = 65_536


def segment_of(pos: str, size: int = SEGMENT_ROWS) -> str:
    return f"(({pos}) DIV {size})"


def ordinal(df: DataFrame, keys: list[str], segment: list[str], order: list[str], name: str) -> DataFrame:
    """Number the rows of each key from 1 in the order (segment, order).

    ``segment`` must be a prefix of the wanted order that cuts a hot key into bounded pieces. The
    offsets of the pieces come from counts, which combine on the map side.
    """
    on = [*keys, *segment]
    part, seg, cols = ", ".join(keys), ", ".join(segment), ", ".join(on)
    offsets = (
        df.groupBy(*on)
        .agg(F.count("*").alias("_n"))
        .selectExpr(
            *[f"{c} AS _k{i}" for i, c in enumerate(on)],
            f"sum(_n) OVER (PARTITION BY {part} ORDER BY {seg} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS _before",
        )
        .filter("_before > 0")
    )
    local = df.selectExpr(
        "*", f"row_number() OVER (PARTITION BY {cols} ORDER BY {', '.join(order)}) AS _local"
    )
    return (
        local.join(offsets, F.expr(" AND ".join(f"{c} <=> _k{i}" for i, c in enumerate(on))), "left")
        .withColumn(name, F.expr("CAST(_local + coalesce(_before, 0) AS BIGINT)"))
        .drop("_local", "_before", *[f"_k{i}" for i in range(len(on))])
    )


def rank_all(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Number all rows of each key by any order, however many a key has.

    The rows are range-partitioned by (keys, order) and written, so that the partition number is fixed and
    cuts a hot key at places that respect the order; :func:`ordinal` does the rest. (keys, order) must be unique.
    """
    ranged = df.repartitionByRange(*keys, *[F.desc(o[:-5]) if o.endswith(" DESC") else F.col(o) for o in order])
    kept = stage(ranged.selectExpr("*", "spark_partition_id() AS _range"), "ranged")
    return ordinal(kept, keys, ["_range"], order, name).drop("_range")


def top_per_key(df: DataFrame, keys: list[str], order: list[str], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each key. ``row_number() <= n`` becomes a group limit that prunes
    before the shuffle, so a hot key moves at most ``n`` rows per task."""
    window = f"row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY {', '.join(order)}) AS {rank}"
    return df.selectExpr("*", window).filter(f"{rank} <= {int(n)}")


def spread(uid: str) -> str:
    """A stable two-digit hex bucket of an id, to cut a hot key into 256 pieces."""
    return f"substring(md5({uid}), 1, 2)"
