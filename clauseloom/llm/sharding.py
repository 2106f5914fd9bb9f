"""Extendible hashing: documents into shards of at most so many bytes, by DataFrame operations only.

A directory is indexed by the leading bits of a hash of the key. A bucket that holds more than the limit is split
on its next bit, and only such a bucket, until every bucket fits. Bytes are summed per prefix before anything is
split, so the loop moves prefixes, not documents: a few levels are settled from one histogram, and only documents
of buckets that still do not fit are counted again on further bits.

Edge cases: a null key hashes as the empty string; a null or empty text has no bytes. After the 60 bits of the key
a second hash, of the row's place, goes on, so equal keys and repeated rows can part as well. One document larger
than the limit fills a shard alone. An empty table gives no rows. Columns other than the key and the text are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.common import HASH_BITS, hash60, numbered
from clauseloom.plans.stage import stage

#: Levels beyond the expected depth that one histogram settles.
SPARE_BITS = 3

#: Levels that every further histogram settles.
STEP_BITS = 8


def _prefix(depth: int) -> Column:
    """The first ``depth`` bits of the two hashes: a pair of numbers in one struct."""
    first, second = min(depth, HASH_BITS), max(0, depth - HASH_BITS)
    return F.struct(
        F.shiftright("h", HASH_BITS - first).alias("a"), F.shiftright("h2", HASH_BITS - second).alias("b")
    )


def _settle(leaves: DataFrame, start: int, end: int, limit: int) -> DataFrame:
    """For every prefix of ``end`` bits the first bucket from ``start`` bits on that fits, or null."""
    cut = lambda side, bits: f"shiftright({side}, {bits})"
    first = f"greatest(0, least({end}, {HASH_BITS}) - least(d, {HASH_BITS}))"
    second = f"greatest(0, greatest(0, {end - HASH_BITS}) - greatest(0, d - {HASH_BITS}))"
    levels = leaves.select("p", "bytes", "rows", F.explode(F.sequence(F.lit(start), F.lit(end))).alias("d")).withColumn(
        "q", F.expr(f"struct({cut('p.a', first)} AS a, {cut('p.b', second)} AS b)")
    )
    buckets = (
        levels.groupBy("d", "q")
        .agg(F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("shard_rows"))
        .filter((F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1) | (F.col("d") >= 2 * HASH_BITS))
    )
    found = levels.select("d", "q", "p").join(buckets.hint("merge"), ["d", "q"]).groupBy("p").agg(
        F.min(F.struct("d", "q", "shard_bytes", "shard_rows")).alias("s")
    )
    return leaves.select("p").join(found.hint("merge"), "p", "left").select("p", "s.*")


def _bits(depth: Column, q: str) -> Column:
    """The prefix as text of ``depth`` binary digits."""
    digits = lambda side, n: F.when(n > 0, F.lpad(F.conv(F.col(f"{q}.{side}").cast("string"), 10, 2), 60, "0"))
    first = F.least(depth, F.lit(HASH_BITS))
    second = depth - first
    return F.concat(
        F.coalesce(F.substring(digits("a", first), F.lit(HASH_BITS + 1) - first, first), F.lit("")),
        F.coalesce(F.substring(digits("b", second), F.lit(HASH_BITS + 1) - second, second), F.lit("")),
    )


def shard(df: DataFrame, key: str, text: str, limit: int) -> DataFrame:
    """One row per row of ``df``: key, n_bytes, shard (its bits), depth, shard_bytes, shard_rows, global_depth."""
    rows = numbered(
        df.select(
            F.col(key).alias("k"),
            hash60(F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("h"),
            F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long")).alias("n_bytes"),
        ),
        "shards",
    )
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    start, end = 0, max(0, math.ceil(math.log2(max(1, total / limit)))) + SPARE_BITS
    open_rows, parts, deepest = rows, [], 0
    while True:
        at = open_rows.withColumn("p", _prefix(end))
        leaves = stage(
            at.groupBy("p").agg(F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("rows")), "shard-sizes"
        )
        directory = stage(_settle(leaves, start, end, limit), "shard-directory")
        depth, unsettled = directory.agg(F.max("d"), F.count_if(F.col("d").isNull())).first()
        deepest = max(deepest, depth or 0)
        placed = at.join(directory.hint("merge"), "p")
        parts.append(placed.filter("d IS NOT NULL"))
        if not unsettled:
            break
        open_rows = placed.filter("d IS NULL").select(*rows.columns)
        start, end = end + 1, min(end + STEP_BITS, 2 * HASH_BITS)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(
        F.col("k").alias(key), "n_bytes", _bits(F.col("d"), "q").alias("shard"), F.col("d").alias("depth"),
        "shard_bytes", "shard_rows", F.lit(deepest).alias("global_depth"),
    )


def write_shards(df: DataFrame, placed: DataFrame, key: str, path: str) -> None:
    """The rows of ``df`` as one folder per shard. The key must be unique here."""
    rows = df.join(placed.select(key, "shard"), key)
    rows.repartition("shard").write.mode("error").partitionBy("shard").parquet(path)
