"""Embedding whitening: principal components of a lattice of embeddings, and every row in their coordinates.

Entries become integers, so that sums over any number of tasks are exact and do not depend on their order. The fit list holds
each distinct vector once. Its centred scatter is put together from exact sums of products of ``x - c``, where ``c`` is the mean
rounded down; only this matrix of dimension squared comes to the driver. There a Cholesky factorisation with diagonal pivots gives
scatter = L L', up to the rank, and one-sided Jacobi rotations make the columns of L orthogonal: their squared norms are the
eigenvalues of the scatter, the normalised columns its eigenvectors. The scatter's accuracy is kept, as L is never squared again.
A second pass over the fit list measures the covariance of the whitened vectors.

Edge cases: rows whose vector is null, empty or holds null or non-finite entries are dropped; repeated rows and a null key stay
and get results; a scaled entry beyond the range of a long becomes the nearest long. Vectors of different lengths have no common covariance:
that is an error which names the lengths. There are as many components as the covariance has rank, ``components`` at most;
one distinct vector or an empty table gives an empty result. A deviation beyond the range of a long is null. Equal eigenvalues
have no order of their own: one basis of them is taken for all rows. The sign makes a component's largest entry positive. Extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.plans.stage import discard, stage

#: Lattice points per unit, and what is added to make them positive.
SCALE, SHIFT = 64, 1_000_000

#: Largest long, and the largest whole number up to which doubles are exact.
LONG, EXACT = (1 << 63) - 1, 1 << 53

#: Columns of the factor count as orthogonal when the cosine between any two is at most this.
COSINE = 1e-15


@dataclass(frozen=True)
class Whitening:
    """What is fitted: vectors ``n``, their ``sums``, whole ``centre``, the ``offset`` of the mean from it, and per component
    the eigenvalue, its share of the trace and the projection already divided by the root of the eigenvalue."""

    n: int
    sums: list[int]
    centre: list[int]
    offset: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    project: np.ndarray

    def whitened(self, y: np.ndarray) -> np.ndarray:
        return (y.astype(np.float64) - self.offset) @ self.project


def lattice(df: DataFrame, key: str, vector: str) -> DataFrame:
    """vec_id and x of the rows that take part."""
    rows = df.select(F.col(key).alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    point = lambda c: F.least(F.floor(c * SCALE), F.lit(LONG - SHIFT)) + SHIFT
    return rows.filter(F.col("v").isNotNull() & (F.size("v") > 0)).filter(fine).select("vec_id", F.transform("v", point).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _whole(array: np.ndarray, bound: int) -> np.ndarray:
    """``array`` as Python integers where sums of it may leave the range of a long."""
    return array if bound <= LONG else array.astype(object)


def _centred(x: np.ndarray, centre: list[int]) -> np.ndarray:
    near = max(int(x.max()), max(centre)) - min(int(x.min()), min(centre)) <= LONG
    return x - np.array(centre, np.int64) if near else x.astype(object) - np.array(centre, object)


def _decimals(values: list) -> pa.Array:
    # As text: Spark reads it into a decimal whatever its length.
    return pa.array([str(int(v)) for v in values], pa.string())


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 8192) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def sums(points: DataFrame) -> tuple[int, list[int]]:
    """How many vectors there are and their sum per dimension. A task sends one row per dimension."""
    lengths = {r["d"]: r["n"] for r in points.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).limit(9).collect()}
    if len(lengths) > 1:
        raise ValueError(f"vectors differ in length: {sorted(lengths.items())} (length, vectors)")
    if not lengths:
        return 0, []
    ((d, n),) = lengths.items()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d, object)
        for batch in _slices(batches):
            x = _matrix(batch.column(0))
            if len(x):
                total += _whole(x, len(x) * max(int(x.max()), -int(x.min()))).sum(axis=0).astype(object)
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(d), pa.int32()), "s": _decimals(total.tolist())})

    found = points.select("x").mapInArrow(run, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    by_dimension = {r["i"]: int(r["s"]) for r in found.collect()}
    return n, [by_dimension[i] for i in range(d)]


def products(points: DataFrame, centre: list[int]) -> np.ndarray:
    """Exact sums of (x - centre)(x - centre)' as Python integers. A task sends one row per entry of the upper triangle."""
    d = len(centre)
    upper = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d), object)
        for batch in _slices(batches):
            x = _matrix(batch.column(0))
            if not len(x):
                continue
            y = _centred(x, centre)
            largest = int(np.abs(y).max())
            if largest * largest * len(y) < EXACT:
                exact = y.astype(np.float64)
                total += (exact.T @ exact).astype(np.int64).astype(object)
            else:
                whole = y.astype(object)
                total += whole.T @ whole
        yield pa.RecordBatch.from_pydict({
            "i": pa.array(upper[0], pa.int32()), "j": pa.array(upper[1], pa.int32()), "s": _decimals(total[upper].tolist()),
        })

    found = points.select("x").mapInArrow(run, "i int, j int, s string")
    out = np.zeros((d, d), object)
    for r in found.groupBy("i", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = int(r["s"])
    return out


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L of as many columns as ``a`` has rank, with a = L L': each column takes out the largest diagonal entry left."""
    d = len(a)
    left, rest = np.zeros((d, d)), a.diagonal().copy()
    least = d * np.finfo(float).eps * max(rest.max(initial=0.0), 0.0)
    order, rank = list(range(d)), 0
    while rank < d:
        at = max(range(rank, d), key=lambda i: rest[order[i]])
        order[rank], order[at] = order[at], order[rank]
        p = order[rank]
        if rest[p] <= least:
            break
        column = (a[:, p] - left[:, :rank] @ left[p, :rank]) / np.sqrt(rest[p])
        column[order[:rank]] = 0.0
        left[:, rank] = column
        rest -= column * column
        rank += 1
    return left[:, :rank]


def one_sided_jacobi(columns: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """``columns`` times a rotation that makes them orthogonal, by falling norm.

    Pairs of one round have no column in common and are rotated at once; the rounds of a sweep meet every pair.
    """
    b = columns[:, np.argsort(-(columns * columns).sum(axis=0), kind="stable")].copy()
    r = b.shape[1]
    seats = list(range(r + r % 2))
    for _ in range(sweeps):
        turned = False
        for _ in range(len(seats) - 1):
            pairs = [(p, q) if p < q else (q, p) for p, q in zip(seats[: len(seats) // 2], reversed(seats[len(seats) // 2 :])) if max(p, q) < r]
            i, j = np.array([p for p, _ in pairs], int), np.array([q for _, q in pairs], int)
            left, right = b[:, i], b[:, j]
            aa, bb, ab = (left * left).sum(axis=0), (right * right).sum(axis=0), (left * right).sum(axis=0)
            todo = np.abs(ab) > COSINE * np.sqrt(aa * bb)
            if todo.any():
                turned = True
                safe = np.where(todo, ab, 1.0)
                zeta = (bb - aa) / (2.0 * safe)
                tan = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                tan = np.where(todo, tan, 0.0)
                cos = 1.0 / np.hypot(1.0, tan)
                sin = cos * tan
                b[:, i], b[:, j] = cos * left - sin * right, sin * left + cos * right
            seats = [seats[0], seats[-1], *seats[1:-1]]
        if not turned:
            break
    return b[:, np.argsort(-(b * b).sum(axis=0), kind="stable")]


def components(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of ``scatter`` by falling value, and its unit eigenvectors as columns."""
    turned = one_sided_jacobi(pivoted_cholesky(scatter))
    norms = np.sqrt((turned * turned).sum(axis=0))
    units = turned / norms
    signs = np.sign(units[np.abs(units).argmax(axis=0), np.arange(units.shape[1])]) if units.size else np.ones(0)
    return norms * norms, units * signs


def fit(points: DataFrame, count: int) -> Whitening | None:
    """The whitening of distinct ``points`` with at most ``count`` components; ``None`` where there are none."""
    n, total = sums(points)
    if not n:
        return None
    centre = [s // n for s in total]
    rest = [s - n * c for s, c in zip(total, centre)]
    gram = products(points, centre)
    scatter = np.array([[float(Fraction(n * int(gram[i, j]) - rest[i] * rest[j], n)) for j in range(len(total))] for i in range(len(total))])
    values, units = components(scatter)
    values, units, whole = values[:count] / n, units[:, :count], scatter.trace() / n
    if not len(values):
        return None
    offset = np.array([float(Fraction(r, n)) for r in rest])
    return Whitening(n, total, centre, offset, values, values / whole, units / np.sqrt(values))


def identity_error(points: DataFrame, model: Whitening) -> float:
    """The largest entry, without sign, of the whitened points' covariance less the identity."""
    k = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in _slices(batches):
            if batch.num_rows:
                w = model.whitened(_centred(_matrix(batch.column(0)), model.centre))
                total += np.vstack([w.T @ w, w.sum(axis=0)])
        yield pa.RecordBatch.from_pydict({"at": pa.array(range((k + 1) * k), pa.int32()), "s": pa.array(total.ravel(), pa.float64())})

    found = points.select("x").mapInArrow(run, "at int, s double").groupBy("at").agg(F.sum("s").alias("s"))
    total = np.zeros((k + 1) * k)
    for r in found.collect():
        total[r["at"]] = r["s"]
    moments = total.reshape(k + 1, k) / model.n
    return float(np.abs(moments[:k] - np.outer(moments[k], moments[k]) - np.eye(k)).max())


RESULT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def transform(points: DataFrame, model: Whitening, error: float) -> DataFrame:
    """Each point in the coordinates of every component, one row per component."""
    k = len(model.values)
    rest = [s - model.n * c for s, c in zip(model.sums, model.centre)]

    def deviations(y: np.ndarray) -> list[int | None]:
        largest = model.n * int(np.abs(y).max()) + model.n
        if largest * largest * y.shape[1] <= LONG:
            z = model.n * y - np.array(rest)
            return (z * z).sum(axis=1).tolist()
        z = model.n * y.astype(object) - np.array(rest, object)
        return [s if s <= LONG else None for s in (z * z).sum(axis=1).tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            rows = batch.num_rows
            if not rows:
                continue
            y = _centred(_matrix(batch.column(1)), model.centre)
            each = pa.array(np.repeat(np.arange(rows), k))
            columns = [
                batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()), pa.array(np.full(rows * k, model.n), pa.int64()),
                pa.array(deviations(y), pa.int64()).take(each), pa.array(model.whitened(y).ravel(), pa.float64()),
                pa.array(np.tile(model.explained, rows), pa.float64()), pa.array(np.full(rows * k, error), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", *[f.split()[0] for f in RESULT.split(", ")]])

    return points.mapInArrow(run, f"vec_id {points.schema['vec_id'].dataType.simpleString()}, {RESULT}")


def whiten(df: DataFrame, key: str, vector: str, count: int = 16) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every row that takes part."""
    points = lattice(df, key, vector)
    # Copies fall together before the shuffle, so one vector may hold any share of the rows.
    distinct = stage(points.select("x").distinct(), "whitening-fit")
    model = fit(distinct, count)
    error = identity_error(distinct, model) if model else 0.0
    discard(distinct)
    if model is None:
        return points.select("vec_id", *[F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in RESULT.split(", ")]).limit(0)
    return transform(points, model, error)
