"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text is counted as pairs of neighbouring bytes of its UTF-8 form, hashed to a fixed number of terms, together with
how often its words repeat. The counts are damped, weighted by inverse document frequency and projected by the
leading singular vectors of the labelled sample. Every document of the table is then compared with all labelled
vectors by one matrix product per block of documents, and its nearest labelled neighbours vote with their similarity.

The labelled sample is bounded by ``per_label`` rows of each label, those with the smallest hash of their id, so the
vectors that are broadcast have a fixed size whatever the table's. A sample of equal halves makes 0.5 the
undecided score. Everything else (features, products, votes) covers all documents and whole texts.

Edge cases: null and empty texts have no terms; their vector is zero, no neighbour is similar, and they get the
neutral score of the vote without neighbours, which is 0. Labels that are null, or whose document is missing, are
not learned from; repeated labels count once each. Without any labelled rows every score is 0.5. Repeated and extra
columns do no harm: only the key and the text are read, never language, source, or the key itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.common import hash60, small_batches, with_made

#: Terms that byte pairs are hashed to, and terms for the share of words that repeat.
PAIR_TERMS, REPEAT_TERMS = 2048, 16
TERMS = PAIR_TERMS + REPEAT_TERMS

#: Documents that meet the labelled vectors in one product.
BLOCK = 256


def terms(text: str) -> np.ndarray:
    """Term counts of one whole text."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    if not len(data):
        return np.zeros(TERMS, np.float32)
    pairs = (np.append(data, 32) + (np.insert(data, 0, 32) << 8)) & 0xFFFF
    counts = np.bincount(((pairs * 40503) & 0xFFFF) >> 5, minlength=TERMS).astype(np.float32)
    words = text.split()
    if words:
        repeated = 1 - len(set(words)) / len(words)
        # One term for each sixteenth of repeated words, as strong as the text is long.
        counts[PAIR_TERMS + min(REPEAT_TERMS - 1, int(repeated * REPEAT_TERMS))] = len(words)
    return counts


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(norms > 0, norms, 1)


class Voters:
    """The labelled vectors, the projection they were made by, and the vote."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, rank: int, neighbours: int, sharpness: float):
        # In place and block by block: the driver holds the counts once.
        seen = np.sum([(counts[i : i + BLOCK] > 0).sum(axis=0) for i in range(0, len(counts), BLOCK)], axis=0)
        self.idf = np.log((1 + len(counts)) / (1 + seen)).astype(np.float32) + 1
        rows = counts
        for i in range(0, len(rows), BLOCK):
            rows[i : i + BLOCK] = _unit(np.log1p(rows[i : i + BLOCK]) * self.idf)
        _, vectors = np.linalg.eigh((rows.T @ rows).astype(np.float64))
        self.basis = vectors[:, ::-1][:, :rank].astype(np.float32)
        self.vectors, self.labels = _unit(rows @ self.basis), labels.astype(np.float32)
        self.neighbours, self.sharpness = min(neighbours, len(counts)), sharpness

    def score(self, counts: np.ndarray) -> np.ndarray:
        near = _unit(_unit(np.log1p(counts) * self.idf) @ self.basis) @ self.vectors.T
        best = np.argpartition(-near, self.neighbours - 1, axis=1)[:, : self.neighbours]
        weight = np.maximum(np.take_along_axis(near, best, axis=1), 0).astype(np.float64) ** self.sharpness
        total = weight.sum(axis=1)
        return (weight * self.labels[best]).sum(axis=1) / np.where(total > 0, total, 1)


def fit(
    docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, per_label: int = 2048, rank: int = 64,
    neighbours: int = 25, sharpness: float = 8.0,
) -> Voters | None:
    """Voters from at most ``per_label`` labelled documents with label 0 and as many with label 1."""
    named = labels.select(F.col(key).alias("k"), F.col(label).alias("label")).dropna()
    order = (hash60(F.col("k")), "k")
    chosen = named.filter("label = 0").orderBy(*order).limit(per_label).unionByName(
        named.filter("label = 1").orderBy(*order).limit(per_label)
    )
    kind = docs.schema[key].dataType.simpleString()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # Packed, as most counts are small: a tenth of the bytes come to the driver.
            yield batch[["k", "label"]].assign(counts=[zlib.compress(terms(t).tobytes(), 1) for t in batch["t"].fillna("")])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), "k")
    # Ordered, so that a repeated run sums in the same order.
    found = rows.mapInPandas(count, f"k {kind}, label int, counts binary").toPandas().sort_values(["k", "counts"])
    if not len(found):
        return None
    labelled = found["label"].to_numpy()
    counts = np.empty((len(found), TERMS), np.float32)
    for i, c in enumerate(found.pop("counts")):
        counts[i] = np.frombuffer(zlib.decompress(c), np.float32)
    del found
    return Voters(counts, labelled, rank, neighbours, sharpness)


def score(docs: DataFrame, text: str, voters: Voters | None, drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` without ``drop`` and with ``score``, from 0 to 1: the weighted share of neighbours of label 1."""
    if voters is None:
        return docs.drop(*drop).withColumn("score", F.lit(0.5))
    model = docs.sparkSession.sparkContext.broadcast(voters)

    def made() -> Callable:
        def make(texts: list[str | None]) -> dict:
            parts = [
                model.value.score(np.stack([terms(t or "") for t in texts[i : i + BLOCK]])) for i in range(0, len(texts), BLOCK)
            ]
            return {"score": np.concatenate(parts) if parts else np.zeros(0)}

        return make

    return with_made(docs, [text], made, "score double", list(drop))
