"""A stored approximate index that takes new vectors without a new fit.

Vectors of unit length fall into lists around centres of two levels: about the fourth root of their number above, as many below each. What is left after
the centre is cut into parts, and each part is replaced by the nearest of at most 256 codes (product quantisation), so that
a list is scored from a few bytes per vector; the best candidates are scored again from the vectors themselves.

The index is a log of commits (:mod:`clauseloom.plans.commits`): the first one fits and stores the model, each further one assigns new
vectors with it. Rows are laid out by ``shelf``, a range of lists, so a search reads only the shelves it probes, and no
embeddings but those of candidates.

Fitting reads a bounded sample (:data:`SAMPLE`, :data:`PER_CENTRE`); every vector is assigned to a list. The model holds as many centres as
the square root of the vectors and goes to every task: 100,000 centres of 384 numbers for 10**10 vectors, 150 MB.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.operators import retrieval as rt
from clauseloom.plans.commits import Log, now
from clauseloom.plans.ordered import top_per_key
from clauseloom.plans.stage import stage

#: Vectors that the upper centres are fitted on, and per lower centre or code, at most.
SAMPLE, PER_CENTRE = 262_144, 64

#: Parts a residual is cut into, codes of each, and shelves the lists are laid out in.
PARTS, CODES, SHELVES = 16, 256, 256

#: Candidates scored again from the vectors, per result wanted.
AGAIN = 8

#: Vectors of a list, and queries that probe it, that meet in one cell.
CELL_ROWS, CELL_QUERIES = 262_144, 4096

#: Numbers of one matrix of distances.
DISTANCES = 1_000_000

_MODEL = "kind string, a int, b int, v array<float>"


@dataclass(frozen=True)
class Model:
    """Centres of lists (number, dimension), and the codes of each part (part, code, width)."""

    centres: np.ndarray
    codes: np.ndarray

    def lists(self, unit: np.ndarray, n: int = 1) -> np.ndarray:
        """The ``n`` nearest lists of each vector, nearest first."""
        return np.concatenate([self._lists(part, n) for part in _pieces(unit, len(self.centres))])

    def _lists(self, unit: np.ndarray, n: int) -> np.ndarray:
        far = (self.centres * self.centres).sum(axis=1) - 2.0 * unit @ self.centres.T
        if n >= far.shape[1]:
            return np.argsort(far, axis=1, kind="stable")
        near = np.argpartition(far, n - 1, axis=1)[:, :n]
        return np.take_along_axis(near, np.argsort(np.take_along_axis(far, near, axis=1), axis=1, kind="stable"), axis=1)

    def parts(self, rest: np.ndarray) -> np.ndarray:
        parts, _, width = self.codes.shape
        padded = np.zeros((len(rest), parts * width), rest.dtype)
        padded[:, : rest.shape[1]] = rest
        return padded.reshape(len(rest), parts, width)

    def encode(self, unit: np.ndarray, lists: np.ndarray) -> np.ndarray:
        cut = self.parts(unit - self.centres[lists])
        return np.stack([_nearest(cut[:, p], self.codes[p]) for p in range(len(self.codes))], axis=1).astype(np.uint8)

    def decode(self, codes: np.ndarray, at: int) -> np.ndarray:
        whole = np.concatenate([self.codes[p][codes[:, p]] for p in range(len(self.codes))], axis=1)
        return self.centres[at] + whole[:, : self.centres.shape[1]]


def _pieces(rows: np.ndarray | pd.DataFrame, width: int) -> list:
    """``rows`` in pieces whose distances to ``width`` others are at most about ``DISTANCES``; at least one piece."""
    step = max(1, DISTANCES // width)
    return [rows[i : i + step] for i in range(0, max(1, len(rows)), step)]


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    own = (centres * centres).sum(axis=1)
    return np.concatenate([(own - 2.0 * part @ centres.T).argmin(axis=1) for part in _pieces(x, len(centres))])


def _centres_of(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """``k`` centres of the rows of ``x``, by Lloyd's rounds from evenly spread rows; fewer if there are fewer different rows."""
    different = np.unique(x, axis=0)
    centres = different[np.linspace(0, len(different) - 1, min(k, len(different))).astype(int)].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        n = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


def _units(column: pd.Series) -> np.ndarray:
    return rt._unit(np.stack(column.to_numpy()).astype("float64"))


def _fit(vectors: DataFrame, key: str, seed: int) -> Model:
    """The model of usable vectors. Upper centres by Spark's k-means; lower centres and codes one group per task."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import Normalizer
    from pyspark.ml.functions import array_to_vector

    n = vectors.count()
    share = -(-n // SAMPLE)
    picked = vectors.filter(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(max(1, share))) == 0) if share > 1 else vectors
    sample = stage(picked.select(F.col(key).alias("_key"), F.col("embedding").cast("array<double>").alias("embedding")), "sample")
    upper = max(1, round(n ** 0.25))
    unit = Normalizer(inputCol="_v", outputCol="_u").transform(sample.withColumn("_v", array_to_vector("embedding")))
    tops = np.array(KMeans(k=upper, seed=seed, maxIter=10, featuresCol="_u").fit(unit).clusterCenters())

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                u = _units(pdf["embedding"])
                yield pd.DataFrame({"top": _nearest(u, tops), "_key": pdf["_key"], "v": list(u)})

    lower = max(1, round(n ** 0.5 / len(tops)))
    kind = sample.schema["_key"].dataType.simpleString()
    placed = stage(sample.mapInPandas(assign, f"top int, _key {kind}, v array<double>"), "placed")
    some = top_per_key(placed.withColumn("_h", F.xxhash64("_key", F.lit(seed))), ["top"], ["_h"], lower * PER_CENTRE)

    def below(pdf: pd.DataFrame) -> pd.DataFrame:
        found = _centres_of(np.stack(pdf["v"].to_numpy()), lower)
        return pd.DataFrame({"v": [c.astype("float32") for c in found], "top": int(pdf["top"].iloc[0])})

    found = some.groupBy("top").applyInPandas(below, "v array<float>, top int").collect()
    centres = np.array([r["v"] for r in sorted(found, key=lambda r: (r["top"], r["v"]))], dtype="float64")
    width = -(-centres.shape[1] // PARTS)
    uncoded = Model(centres, np.zeros((-(-centres.shape[1] // width), 1, width)))

    def residuals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                u = np.stack(pdf["v"].to_numpy())
                cut = uncoded.parts(u - centres[uncoded.lists(u)[:, 0]])
                for p in range(cut.shape[1]):
                    yield pd.DataFrame({"p": p, "_key": pdf["_key"], "v": list(cut[:, p])})

    rest = placed.mapInPandas(residuals, f"p int, _key {kind}, v array<double>").withColumn("_h", F.xxhash64("_key", F.lit(seed)))

    def codes(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _centres_of(np.stack(pdf["v"].to_numpy()), CODES)
        return pd.DataFrame({"p": int(pdf["p"].iloc[0]), "c": range(len(x)), "v": [c.astype("float32") for c in x]})

    told = top_per_key(rest, ["p"], ["_h"], CODES * PER_CENTRE).groupBy("p").applyInPandas(codes, "p int, c int, v array<float>").collect()
    book = np.full((len(uncoded.codes), CODES, width), np.inf)
    for r in told:
        book[r["p"], r["c"]] = r["v"]
    # Codes that no part needed are so far away that nothing is nearest to them.
    return Model(centres, np.where(np.isfinite(book), book, 1e6))


class VectorIndex:
    """An index in a folder. ``key`` names the vectors; equal keys are equal to a search."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.log = spark, Log(spark, root)
        first = self.log.commits[0]
        rows = spark.read.schema(_MODEL).parquet(f"{first.folder}/model").collect()
        centres = np.array([r["v"] for r in sorted((r for r in rows if r["kind"] == "centre"), key=lambda r: r["a"])], dtype="float64")
        codes = [r for r in rows if r["kind"] == "code"]
        book = np.zeros((max(r["a"] for r in codes) + 1, max(r["b"] for r in codes) + 1, len(codes[0]["v"])))
        for r in codes:
            book[r["a"], r["b"]] = r["v"]
        self.model = Model(centres, book)
        self.schema = spark.read.parquet(f"{first.folder}/lists").schema
        self.key = self.schema.names[0]

    @staticmethod
    def create(vectors: DataFrame, root: str, key: str = "vec_id", seed: int = 7) -> VectorIndex:
        """Fit a model to ``vectors`` and store them by it. There must be at least one that is usable."""
        spark, log, started = vectors.sparkSession, Log(vectors.sparkSession, root), now()
        fine = rt.usable(vectors)
        if fine.isEmpty():
            raise ValueError("no usable vectors to fit an index to")
        model = _fit(fine, key, seed)
        folder = log.fresh()
        rows = [("centre", i, 0, c.tolist()) for i, c in enumerate(model.centres)]
        rows += [("code", p, c, v.tolist()) for p, part in enumerate(model.codes) for c, v in enumerate(part)]
        spark.createDataFrame(rows, _MODEL).write.mode("error").parquet(f"{folder}/model")
        VectorIndex._write(fine, model, key, folder)
        log.commit(folder, ["model", "lists"], started)
        return VectorIndex(spark, root)

    @staticmethod
    def _write(vectors: DataFrame, model: Model, key: str, folder: str) -> None:
        kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
        per = -(-len(model.centres) // SHELVES)

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    u = _units(pdf["embedding"])
                    lists = model.lists(u)[:, 0]
                    yield pdf.assign(list_id=lists, code=[c.tobytes() for c in model.encode(u, lists)], shelf=lists // per)

        # Ranges of lists: a large list has several files, a file few lists.
        out = vectors.select(key, "embedding").mapInPandas(place, f"`{key}` {kinds[key]}, embedding {kinds['embedding']}, list_id int, code binary, shelf int")
        out.repartitionByRange("shelf", "list_id", key).sortWithinPartitions("shelf", "list_id").write.mode("error").partitionBy("shelf").parquet(f"{folder}/lists")

    def append(self, vectors: DataFrame, writer: str | None = None, batch: int | None = None) -> None:
        """Store further vectors by the model as it is. A writer's batch that is stored already is left out."""
        self.log.refresh()
        if writer is not None and batch is not None and self.log.holds(writer, batch):
            return
        started, folder = now(), self.log.fresh()
        self._write(rt.usable(vectors), self.model, self.key, folder)
        self.log.commit(folder, ["lists"], started, writer=writer, batch=batch)

    def rows(self) -> DataFrame:
        """Everything stored: the key, ``embedding``, ``list_id``, ``code``, ``shelf``."""
        paths = [f"{c.folder}/lists" for c in self.log.commits if "lists" in c.tables]
        out = self.spark.read.schema(self.schema).parquet(paths[0])
        for path in paths[1:]:
            out = out.unionByName(self.spark.read.schema(self.schema).parquet(path))
        return out

    def search(self, queries: DataFrame, k: int, probe: int, exact_lists: bool = False) -> DataFrame:
        """``query_id, <key>, score, rank``: the best ``k`` by cosine in the ``probe`` lists nearest to each query.

        Lists are scored by their codes and the best ``AGAIN * k`` again by the vectors; with ``exact_lists`` by the vectors at once. A list
        of many vectors or many queries is searched in several cells.
        """
        key, model, probe = self.key, self.model, max(1, min(probe, len(self.model.centres)))
        per = -(-len(model.centres) // SHELVES)

        def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for rows in _pieces(pdf, max(probe, len(model.centres))):
                    if len(rows):
                        yield rows.assign(list_id=list(model.lists(_units(rows["embedding"]), probe).astype("int32")))

        asked = rt.one_per_query(queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding")))
        probes = stage(asked.mapInPandas(near, "query_id long, embedding array<double>, list_id array<int>").withColumn("list_id", F.explode("list_id")), "probes")
        # One row per list at most comes to the driver, as many as the model has centres.
        asking = {r["list_id"]: r["n"] for r in probes.groupBy("list_id").agg(F.count("*").alias("n")).collect()}
        shelves = sorted({x // per for x in asking})
        stored = self.rows().filter(F.col("shelf").isin(shelves) & F.col("list_id").isin(sorted(asking)))
        held = {r["list_id"]: r["n"] for r in stored.groupBy("list_id").agg(F.count("*").alias("n")).collect()}
        sizes = self.spark.createDataFrame(
            [(x, -(-n // CELL_ROWS), -(-asking[x] // CELL_QUERIES)) for x, n in held.items()], "list_id int, pieces int, parts int")
        pieces = F.broadcast(sizes)
        cell = F.concat_ws("/", "list_id", "piece", "part").alias("cell")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        ask = probes.join(pieces, "list_id").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts"))).withColumn("piece", every("pieces"))
        have = stored.join(pieces, "list_id").withColumn("piece", F.pmod(F.xxhash64(key), F.col("pieces"))).withColumn("part", every("parts"))
        ask = ask.select(cell, "query_id", "embedding")
        if exact_lists:
            found = rt.in_cells(ask, have.select(cell, key, "embedding"), k, key)
            return top_per_key(found, ["query_id"], ["score DESC", key], k)

        def decode(cell: str, codes: pd.Series) -> np.ndarray:
            whole = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
            return model.decode(whole, int(cell.split("/")[0]))

        rough = rt.in_cells(ask, have.select(cell, key, "code"), AGAIN * k, key, codes="code", decode=decode)
        likely = stage(top_per_key(rough, ["query_id"], ["score DESC", key], AGAIN * k).select("query_id", key), "likely")
        vectors = stored.select(key, F.col("embedding").cast("array<double>").alias("_v"))
        both = likely.join(vectors, key).join(asked, "query_id")
        norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
        dot = F.aggregate(F.zip_with("_v", "embedding", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
        length = norm("_v") * norm("embedding")
        scored = both.select("query_id", key, F.when(length > 0, dot / length).otherwise(0.0).alias("score")).distinct()
        return top_per_key(scored, ["query_id"], ["score DESC", key], k)

    def recall(self, queries: DataFrame, k: int, probe: int, exact: DataFrame) -> float:
        """The share of the rows of ``exact``, an exact search for the same queries, that ``probe`` lists find."""
        found = self.search(queries, k, probe).selectExpr("query_id", self.key, "true AS hit")
        hits, wanted = exact.join(found, ["query_id", self.key], "left").agg(F.count("hit"), F.count("*")).first()
        return hits / wanted if wanted else 1.0

    def probes_for(self, queries: DataFrame, k: int, least: float = 0.95) -> int:
        """How many lists to probe for a recall of ``least`` on sample ``queries``: doubled until it is reached."""
        exact = stage(rt.vector_search(queries, self.rows(), k, self.key).select("query_id", self.key), "exact")
        probe, lists = 1, len(self.model.centres)
        while probe < lists and self.recall(queries, k, probe, exact) < least:
            probe = min(2 * probe, lists)
        return probe
