"""Exact top-k by inner product with a table of pivots.

With one more component, which brings every vector to the length of the longest and is 0 for queries, the largest
inner product is the smallest distance. Distances from a vector to the pivots are known beforehand; by the triangle
inequality the difference of two such distances bounds the distance of a query from a vector from below. A query looks
at the vectors of a block in the order of their largest bound over all pivots and stops when the next bound is
beyond the k-th best distance found, which the pivots themselves start off. What is evaluated is scored in integers.

Blocks of vectors meet blocks of queries, both of bounded size, and the best of each block are merged in rounds.

Edge cases: vectors that are null, empty or hold null or non-finite components take no part, nor do rows without an
id. Rows with the query's id are its own and no candidates; of query rows with equal ids the smallest vector asks. With
fewer than k candidates all are returned. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.common import hash60
from clauseloom.llm.vectors import best, block_of, matrix, meet, usable
from clauseloom.plans.stage import stage

#: Pivots are chosen, each farthest from those before it, among so many rows with the smallest hash.
PIVOTS, PIVOT_SAMPLE = 32, 512

#: Vectors and queries of a block, and how many vectors a query evaluates before it looks at the bound again.
VECTORS, QUERIES, STEP = 8192, 1024, 128

#: Distances that differ by less, relative to the longest vector, count as equal when bounds are compared.
SLACK = 1e-9


def lengths(v: np.ndarray, longest: float) -> np.ndarray:
    """The component that brings every row to the length of the longest."""
    return np.sqrt(np.maximum(0.0, longest - (v * v).sum(axis=1)))


def distances(a: np.ndarray, extra_a: np.ndarray, b: np.ndarray, extra_b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T) + (extra_a[:, None] - extra_b[None, :]) ** 2
    return np.sqrt(np.maximum(0.0, square))


def spread(sample: np.ndarray, longest: float, wanted: int) -> list[int]:
    """Rows far from each other: each the farthest from those before it; copies of a pivot are never pivots."""
    extra = lengths(sample, longest)
    chosen, far = [0], np.full(len(sample), np.inf)
    while len(chosen) < min(wanted, len(sample)):
        last = chosen[-1:]
        far = np.minimum(far, distances(sample, extra, sample[last], extra[last])[:, 0])
        if far.max() <= 1e-6:
            break
        chosen.append(int(far.argmax()))
    return chosen


def search(
    ids: np.ndarray, v: np.ndarray, query_ids: np.ndarray, q: np.ndarray, pivot_ids: np.ndarray, pivots: np.ndarray,
    longest: float, k: int,
) -> tuple[list[tuple[int, int, int]], int]:
    """(query, vector, score) of the best in one block, and how many scores were evaluated."""
    slack = SLACK * max(1.0, np.sqrt(longest))
    pivot_extra = lengths(pivots, longest)
    of_vectors = distances(pivots, pivot_extra, v, lengths(v, longest))
    of_queries = distances(q, np.zeros(len(q)), pivots, pivot_extra)
    whole, out, evaluated = v.astype(np.int64), [], 0
    for n, asked in enumerate(query_ids):
        bound = np.abs(of_vectors - of_queries[n][:, None]).max(axis=0)
        known = np.sort(of_queries[n][pivot_ids != asked])
        limit = known[k - 1] if len(known) >= k else np.inf
        own, square = q[n].astype(np.int64), float((q[n] * q[n]).sum())
        near = np.flatnonzero((bound <= limit + slack) & (ids != asked))
        near = near[np.argsort(bound[near], kind="stable")]
        scores, at = np.zeros(0, np.int64), 0
        while at < len(near) and bound[near[at]] <= limit + slack:
            scores = np.concatenate((scores, whole[near[at : at + STEP]] @ own))
            at += STEP
            if len(scores) >= k:
                kth = np.partition(scores, len(scores) - k)[len(scores) - k]
                limit = min(limit, np.sqrt(max(0.0, square + longest - 2.0 * float(kth))))
        evaluated += len(scores)
        seen = ids[near[: len(scores)]]
        out += [(int(asked), int(seen[i]), int(scores[i])) for i in np.lexsort((seen, -scores))[:k]]
    return out, evaluated


def top_k(df: DataFrame, key: str, vector: str, integer: Column, is_query: Column, k: int) -> DataFrame:
    """query_id, rank, vec_id, score. ``integer`` turns the array ``v`` into whole numbers, ``is_query`` looks at vec_id."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [np.asarray(x, np.float64) for x in batch["v"]]
            yield pd.DataFrame({"vec_id": batch["vec_id"], "v": [r.tobytes() for r in rows], "square": [float((r * r).sum()) for r in rows]})

    whole = usable(df, key, vector).select("vec_id", integer.cast("array<double>").alias("v"))
    rows = stage(whole.mapInPandas(pack, "vec_id long, v binary, square double"), "topk-vectors")
    n, longest = rows.agg(F.count(F.lit(1)), F.max("square")).first()
    asking = rows.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    asking = stage(asking.withColumnRenamed("vec_id", "query_id"), "topk-queries")
    n_asking = asking.count()
    if not n_asking:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sample = rows.orderBy(hash60(F.col("vec_id")), "vec_id", "v").limit(PIVOT_SAMPLE).select("vec_id", "v").toPandas()
    chosen = spread(matrix(sample["v"]), longest, PIVOTS)
    pivot_ids, pivots = sample["vec_id"].to_numpy()[chosen], matrix(sample["v"])[chosen]
    blocks, query_blocks = -(-n // VECTORS), -(-n_asking // QUERIES)

    def run(key: tuple, vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(vectors) and len(queries):
            out, _ = search(
                vectors["vec_id"].to_numpy(), matrix(vectors["v"]), queries["query_id"].to_numpy(), matrix(queries["v"]),
                pivot_ids, pivots, longest, k,
            )
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).assign(block=int(key[0]))

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("vec_id", "v", block_of(F.col("vec_id"), blocks, 1).alias("block"), every(query_blocks).alias("asking"))
    right = asking.select("query_id", "v", block_of(F.col("query_id"), query_blocks, 2).alias("asking"), every(blocks).alias("block"))
    found = meet(left, right, ["block", "asking"], run, "query_id long, vec_id long, score long, block int")
    return best(found, k, blocks).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
