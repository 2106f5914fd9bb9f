"""Approximate nearest neighbours: a kd-tree over a few stable projections.

With one more component, which brings every vector to the length of the longest and is 0 for queries, the largest
inner product is the smallest distance. Vectors are projected by a few Gaussian directions: the square of a projected
distance, over the square of the true one, follows the chi-square distribution with as many degrees of freedom.
So projected neighbours are verified leaf by leaf in the order of their projected distance, until the next leaf lies so far away that a
vector nearer than the k-th best found would be that far with small probability only; of the leaves before it those points are left
out that lie so far themselves. The more of the vectors' dimension the directions cover, the fewer points that are: for unit vectors of 64 dimensions
without clusters, which no index can part well, 53 % of 2,000 and 38 % of 12,800 vectors are verified, with a recall of 0.95.

The kd-tree has two levels. Its upper part is fitted on a bounded sample and cuts all vectors into cells; a cell is
searched in blocks of bounded size, each with a kd-tree of its own. A query first searches the cell that it falls in,
which gives a bound, and then those cells that the stopping test does not rule out by their bounding box.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without
an id. Rows with the query's id are its own and no candidates; of query rows with equal ids the smallest vector asks.
Equal scores go to the smaller id. With fewer than k candidates all are returned. An empty table gives no rows. Extra
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.common import hash60
from clauseloom.llm.vectors import best, block_of, matrix, meet, usable
from clauseloom.plans.stage import stage

#: Projections (even), the confidence of the stopping test, and the seed of the directions.
DIRECTIONS, CONFIDENCE, SEED = 32, 0.9, 11

#: Rows with the smallest hash that the upper tree is fitted on, and its cells at most.
SAMPLE, CELLS = 16_384, 4096

#: Vectors of a cell that it is planned for, vectors and queries of a block, vectors of a leaf.
CELL_ROWS, BLOCK_ROWS, QUERIES, LEAF = 8192, 16_384, 1024, 128

#: Projected distances that differ by less count as equal in the test.
SLACK = 1e-9


def reach(confidence: float, degrees: int) -> float:
    """How many times the true distance the projected one is at most, with the given confidence."""
    below = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(degrees // 2))
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < confidence else (lo, mid)
    return math.sqrt(hi)


class Cuts:
    """A kd-tree that halves points at the median of their widest direction, down to cells of ``size`` points."""

    def __init__(self, points: np.ndarray, cells: int):
        # Per node: direction, place of the cut, and the nodes on both sides; a leaf has direction -1 and its cell's number.
        self.nodes: list[list[float]] = []
        self.cells = 0
        self._grow(points, cells)

    def _grow(self, points: np.ndarray, cells: int) -> int:
        at = len(self.nodes)
        self.nodes.append([-1, 0.0, self.cells, 0])
        wide = points.max(axis=0) - points.min(axis=0) if len(points) else np.zeros(1)
        if cells <= 1 or wide.max() <= 0:
            self.cells += 1
            return at
        d = int(wide.argmax())
        cut = float(np.median(points[:, d]))
        side = points[:, d] <= cut
        if side.all():
            side = points[:, d] < cut
            cut = float(points[side, d].max())
        left = self._grow(points[side], cells // 2)
        self.nodes[at] = [d, cut, left, self._grow(points[~side], cells - cells // 2)]
        return at

    def cell(self, points: np.ndarray) -> np.ndarray:
        out, waiting = np.zeros(len(points), np.int32), [(0, np.arange(len(points)))]
        while waiting:
            node, rows = waiting.pop()
            d, cut, left, right = self.nodes[node]
            if d < 0:
                out[rows] = left
            elif len(rows):
                side = points[rows, int(d)] <= cut
                waiting += [(int(left), rows[side]), (int(right), rows[~side])]
        return out


def leaves(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The points in the order of a kd-tree's leaves, where each leaf starts, and the leaves' boxes."""
    cell = Cuts(points, max(1, -(-len(points) // LEAF))).cell(points)
    order = np.argsort(cell, kind="stable")
    starts = np.flatnonzero(np.concatenate(([True], np.diff(cell[order]) > 0)))
    return order, starts, np.minimum.reduceat(points[order], starts), np.maximum.reduceat(points[order], starts)


def box_distance(point: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return np.sqrt((np.maximum(0.0, np.maximum(low - point, point - high)) ** 2).sum(axis=1))


def search(
    ids: np.ndarray, v: np.ndarray, projected: np.ndarray, query_ids: np.ndarray, q: np.ndarray, q_projected: np.ndarray,
    bounds: np.ndarray, longest: float, far: float, k: int, verified: list[int] | None = None,
) -> list[tuple[int, int, float]]:
    """(query, vector, score) of the best that a block has. ``verified`` takes up how many vectors were compared for each query.

    All queries go through their leaves from near to far, twice as many in every round. Of a leaf that the test does not rule
    out by its box, the points that it does not rule out themselves are verified. A query ends when its next leaf is too far.
    """
    order, starts, low, high = leaves(projected)
    ids, v, points = ids[order], v[order], projected[order]
    ends, m = np.append(starts[1:], len(ids)), len(query_ids)
    away = np.stack([box_distance(x, low, high) for x in q_projected])
    nearest = np.argsort(away, axis=1, kind="stable")
    square, point_square, q_square = (q * q).sum(axis=1), (points * points).sum(axis=1), (q_projected * q_projected).sum(axis=1)
    rounding = 1e-9 * (1 + np.sqrt(square * longest))
    bound, worst, compared = bounds.astype(np.float64).copy(), np.full(m, -np.inf), np.zeros(m, np.int64)
    best_q, best_ids, best_scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    at, step = 0, 2
    while at < len(starts):
        limit = far * bound + SLACK
        part = nearest[:, at : at + step]
        asking, place = np.nonzero(np.take_along_axis(away, part, axis=1) <= limit[:, None])
        if not len(asking):
            break
        leaf = part[asking, place]
        sorted_by = np.argsort(leaf, kind="stable")
        asking, leaf = asking[sorted_by], leaf[sorted_by]
        new_q, new_ids, new_scores = [best_q], [best_ids], [best_scores]
        for these in np.split(np.arange(len(leaf)), np.flatnonzero(np.diff(leaf)) + 1):
            sub, rows = asking[these], slice(starts[leaf[these[0]]], ends[leaf[these[0]]])
            apart = q_square[sub, None] + point_square[rows] - 2 * q_projected[sub] @ points[rows].T
            near = (apart <= limit[sub, None] ** 2 + SLACK) & (ids[rows] != query_ids[sub, None])
            compared += np.bincount(sub, near.sum(axis=1), m).astype(np.int64)
            # Only what may be among the best is summed again row by row in one order, so that equal vectors have equal scores.
            x, y = np.nonzero(near & (q[sub] @ v[rows].T >= (worst - rounding)[sub, None]))
            new_q.append(sub[x])
            new_ids.append(ids[rows][y])
            new_scores.append((v[rows][y] * q[sub[x]]).sum(axis=1))
        best_q, best_ids, best_scores = np.concatenate(new_q), np.concatenate(new_ids), np.concatenate(new_scores)
        first = np.lexsort((best_ids, -best_scores, best_q))
        best_q, best_ids, best_scores = best_q[first], best_ids[first], best_scores[first]
        rank = np.arange(len(best_q)) - np.searchsorted(best_q, best_q)
        best_q, best_ids, best_scores, rank = (a[rank < k] for a in (best_q, best_ids, best_scores, rank))
        last = rank == k - 1
        worst[best_q[last]] = best_scores[last]
        full = best_q[last]
        bound[full] = np.minimum(bound[full], np.sqrt(np.maximum(0.0, square[full] + longest - 2 * worst[full])))
        at, step = at + step, step * 2
    if verified is not None:
        verified += compared.tolist()
    return list(zip(query_ids[best_q].tolist(), best_ids.tolist(), best_scores.tolist()))


def neighbours(df: DataFrame, key: str, vector: str, is_query: Column, k: int) -> DataFrame:
    """query_id, rank, vec_id, score (the inner product of the original vectors). ``is_query`` looks at vec_id."""
    spark = df.sparkSession
    rows = usable(df, key, vector).filter(F.exists("v", lambda x: x != 0))
    rows = rows.withColumn("square", F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    n, longest, width = rows.agg(F.count(F.lit(1)), F.max("square"), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    directions = np.random.default_rng(SEED).standard_normal((width + 1, DIRECTIONS))
    far = reach(CONFIDENCE, DIRECTIONS)

    def project(v: np.ndarray, extra: np.ndarray) -> np.ndarray:
        return v @ directions[:-1] + extra[:, None] * directions[-1]

    def extra(v: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, longest - (v * v).sum(axis=1)))

    chosen = rows.orderBy(hash60(F.col("vec_id")), "vec_id").limit(SAMPLE).select("v").toPandas()["v"]
    sample = np.stack([np.asarray(x, np.float64) for x in chosen])
    cuts = Cuts(project(sample, extra(sample)), min(CELLS, -(-n // CELL_ROWS)))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            v = np.stack([np.asarray(x, np.float64) for x in batch["v"]])
            p, asked = project(v, extra(v)), project(v, np.zeros(len(v)))
            yield pd.DataFrame({
                "vec_id": batch["vec_id"].to_numpy(), "v": [x.tobytes() for x in v], "p": list(p), "cell": cuts.cell(p),
                "home": cuts.cell(asked),
            })

    packed = stage(rows.select("vec_id", "v").mapInPandas(pack, "vec_id long, v binary, p array<double>, cell int, home int"), "ann-vectors")
    # One row per cell, and there are at most CELLS of them.
    sides = [f(F.col("p")[d]).alias(f"{name}{d}") for name, f in (("lo", F.min), ("hi", F.max)) for d in range(DIRECTIONS)]
    cells = packed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *sides).toPandas().sort_values("cell").reset_index(drop=True)
    low, high = cells[[f"lo{d}" for d in range(DIRECTIONS)]].to_numpy(), cells[[f"hi{d}" for d in range(DIRECTIONS)]].to_numpy()
    numbers = cells["cell"].to_numpy()
    blocks = {int(c): -(-int(m) // BLOCK_ROWS) for c, m in zip(cells["cell"], cells["n"])}
    most = max(blocks.values())

    def visited(home: bool) -> object:
        """Which cells a query searches: its own, or the others that the test leaves."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for i, (v, bound, own) in enumerate(zip(batch["v"], batch["bound"], batch["home"])):
                    point = project(np.frombuffer(v, np.float64)[None, :], np.zeros(1))[0]
                    away = box_distance(point, low, high)
                    here = int(np.argmin(away)) if own not in blocks else int(np.flatnonzero(numbers == own)[0])
                    reached = [here] if home else [j for j in np.flatnonzero(away <= far * bound + SLACK) if j != here]
                    out += [(i, int(numbers[j]), b) for j in reached for b in range(blocks[int(numbers[j])])]
                at = [o[0] for o in out]
                yield batch[["query_id", "v", "bound"]].iloc[at].assign(cell=[o[1] for o in out], part=[o[2] for o in out])

        return run

    parts = F.create_map(*[F.lit(x) for c, b in blocks.items() for x in (c, b)]) if most > 1 else None
    part = F.lit(0) if parts is None else block_of(F.col("vec_id"), F.element_at(parts, F.col("cell")), 3)
    vectors = packed.select("vec_id", "v", "cell", part.alias("part"))

    def run(key: tuple, vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(vectors) and len(queries):
            v, q = matrix(vectors["v"]), matrix(queries["v"])
            out = search(
                vectors["vec_id"].to_numpy(), v, project(v, extra(v)), queries["query_id"].to_numpy(), q,
                project(q, np.zeros(len(q))), queries["bound"].to_numpy(), longest, far, k,
            )
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).assign(block=int(key[0]) * most + int(key[1]))

    def searched(routed: DataFrame) -> DataFrame:
        """The best of every block that a query visits. Queries of one block go in as many groups as they fill."""
        routed = stage(routed, "ann-routes")
        asked = routed.groupBy("cell", "part").agg(F.count(F.lit(1)).alias("m"))
        groups = asked.select("cell", "part", F.ceil(F.col("m") / QUERIES).cast("int").alias("groups"))
        left = vectors.join(groups, ["cell", "part"]).withColumn("asking", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")
        right = routed.join(groups, ["cell", "part"]).withColumn("asking", block_of(F.col("query_id"), F.col("groups"), 4)).drop("groups")
        return meet(left, right, ["cell", "part", "asking"], run, "query_id long, vec_id long, score double, block int")

    asking = packed.filter(is_query).groupBy("vec_id").agg(F.min(F.struct("v", "home")).alias("x"))
    asking = stage(asking.select(F.col("vec_id").alias("query_id"), "x.v", "x.home", F.lit(float("inf")).alias("bound")), "ann-queries")
    schema = "query_id long, v binary, bound double, cell int, part int"
    n_blocks = (int(numbers.max()) + 1) * most
    near = stage(best(searched(asking.mapInPandas(visited(True), schema)), k, n_blocks), "ann-near")
    reached = near.groupBy("query_id").agg(F.count(F.lit(1)).alias("found"), F.min("score").alias("worst"))

    def bounded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = np.array([float((np.frombuffer(v, np.float64) ** 2).sum()) for v in batch["v"]])
            bound = np.sqrt(np.maximum(0.0, own + longest - 2 * batch["worst"].fillna(0).to_numpy(np.float64)))
            yield batch[["query_id", "v", "home"]].assign(bound=np.where(batch["found"].fillna(0).to_numpy() >= k, bound, np.inf))

    again = asking.drop("bound").join(reached, "query_id", "left").mapInPandas(bounded, "query_id long, v binary, home int, bound double")
    wide = searched(again.mapInPandas(visited(False), schema))
    found = near.select("query_id", "vec_id", "score", F.lit(0).alias("block")).unionByName(wide)
    return best(found, k, n_blocks + 1).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
