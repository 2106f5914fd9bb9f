"""Substring dedup by seed and extend, without ever forming pairs of documents.

Seeds: every text is cut into words, every run of ``SEED`` words is hashed, and in every window of ``length`` words
the run with the smallest hash (the leftmost of equals) is its anchor. Which run that is depends on the window's words
alone, so equal windows have equal anchors at equal places. Documents meet on anchors that occur more than once.

Extension: around an anchor lie all windows that chose it, from its first to its last word. Where all occurrences
of an anchor have the same words there, all of those windows match as far as they go, and a count settles thousands
of copies. Otherwise each alignment is extended: the windows around the anchor are hashed with 96 bits, and those
that occur again are matches. This is what extending all pairs of occurrences to both sides would find, at a cost
that is linear in the occurrences, however many share an anchor.

Maximal repeats: matching windows that touch or overlap within a document are one repeat of ``length`` words or more.

Edge cases: null and empty texts and texts under ``length`` words have no windows. A window that occurs twice in one
document is a repeat, so a repeated row has all its windows repeated. Rows with equal keys are told apart by their
texts; rows equal in both get equal results, one for each. Null keys are allowed. Extra columns are carried along.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.common import beside, small_batches, with_made
from clauseloom.plans.stage import discard, stage

#: Words are runs without a space or one of the five control characters that count as white space.
WORD = re.compile("[^\x20\x09-\x0d]+")

#: Words of a seed; a shorter window is its own seed.
SEED = 12

#: Distinct words that a task remembers before it starts over.
REMEMBERED = 300_000

#: Odd numbers that the rolling hashes are built on, one for each of two hashes, and their inverses.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)

#: Windows of one task that are handed over at once.
CHUNK = 200_000


class Rolling:
    """Hashes of any run of words of a text, from prefix sums."""

    def __init__(self) -> None:
        self.memo: dict[str, bytes] = {}
        self.powers: list[np.ndarray] = []

    def _word_hashes(self, words: list[str]) -> np.ndarray:
        import xxhash

        if len(self.memo) > REMEMBERED:
            self.memo.clear()
        memo = self.memo
        for w in set(words):
            if w not in memo:
                memo[w] = xxhash.xxh3_128_digest(w.encode("utf-8", "replace"))
        return np.frombuffer(b"".join(map(memo.__getitem__, words)), "<u8").reshape(-1, 2)

    def load(self, words: list[str]) -> None:
        n = len(words)
        if not self.powers or len(self.powers[0]) <= n:
            ones = [np.full(2 * n + 1, b, np.uint64) for b in (*BASES, *INVERSES)]
            for p in ones:
                p[0] = 1
            self.powers = [np.cumprod(p, dtype=np.uint64) for p in ones]
        hashes = self._word_hashes(words)
        self.sums = [
            np.concatenate(([np.uint64(0)], np.cumsum(hashes[:, i] * self.powers[i][:n], dtype=np.uint64))) for i in (0, 1)
        ]

    def run(self, half: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of words ``start`` to ``end`` of the loaded text."""
        sums = self.sums[half]
        return mixed((sums[end] - sums[start]) * self.powers[2 + half][start])


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def anchors(rolling: Rolling, words: list[str], length: int) -> tuple[np.ndarray, ...]:
    """Per anchor of a text: its hash, the hash of all the words around it, its first and its last window."""
    n = len(words) - length + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.int32))
    rolling.load(words)
    seed = min(SEED, length)
    grams = np.arange(len(words) - seed + 1)
    seeds = rolling.run(0, grams, grams + seed)
    views = np.lib.stride_tricks.sliding_window_view(seeds, length - seed + 1)
    at = np.arange(n) + views.argmin(axis=1)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.concatenate((first[1:] - 1, [n - 1]))
    around = rolling.run(1, first, last + length) + mixed(((at[first] - first) << 32 | (last - first)).astype(np.uint64))
    return seeds[at[first]].view(np.int64), around.view(np.int64), first.astype(np.int32), last.astype(np.int32)


def _with_row(df: DataFrame, key: str, text: str, keep: list[str]) -> DataFrame:
    """``k`` and ``v`` tell rows apart, ``t`` is the text."""
    return df.select(
        F.col(key).alias("k"), F.hash(F.col(text)).alias("v"), F.coalesce(F.col(text), F.lit("")).alias("t"),
        *[F.col(c).alias(f"_keep_{c}") for c in keep],
    )


def _same_row(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    renamed = right.withColumnsRenamed({"k": "_k", "v": "_v"})
    on = left["k"].eqNullSafe(renamed["_k"]) & (left["v"] == renamed["_v"])
    return left.join(renamed, on, how).drop("_k", "_v")


def repeats(df: DataFrame, key: str, text: str, length: int) -> DataFrame:
    """``k``, ``v`` and ``spans``: parts of a row's repeats as an array of (first word, one after the last)."""
    small_batches(df.sparkSession)
    docs = _with_row(df, key, text, [])
    kind = docs.schema["k"].dataType.simpleString()

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in batches:
            found = [anchors(rolling, WORD.findall(t), length) for t in batch.column("t").to_pylist()]
            if found:
                rows = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
                columns = dict(zip(("anchor", "around", "lo", "hi"), map(np.concatenate, zip(*found))))
                yield beside(batch, ["k", "v"], columns, rows)

    seeds = stage(docs.mapInArrow(seed, f"k {kind}, v int, anchor long, around long, lo int, hi int"), "substring-seeds")
    groups = (
        seeds.groupBy("anchor")
        .agg(F.count(F.lit(1)).alias("n"), (F.min("around") != F.max("around")).alias("differ"))
        .filter("n > 1").drop("n")
    )
    met = stage(seeds.drop("around").join(groups, "anchor").select("k", "v", "lo", "hi", "differ"), "substring-met")
    discard(seeds)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in batches:
            parts, size = [], 0
            for row, (t, spans) in enumerate(zip(batch.column("t").to_pylist(), batch.column("spans").to_pylist())):
                rolling.load(WORD.findall(t))
                s = np.concatenate([np.arange(x["lo"], x["hi"] + 1) for x in spans])
                a, b = (rolling.run(i, s, s + length).view(np.int64) for i in (0, 1))
                parts.append((np.full(len(s), row), s.astype(np.int32), a, b.astype(np.int32)))
                size += len(s)
                if size >= CHUNK or row == batch.num_rows - 1:
                    rows, *columns = map(np.concatenate, zip(*parts))
                    yield beside(batch, ["k", "v"], dict(zip(("s", "a", "b"), columns)), rows)
                    parts, size = [], 0

    open_spans = met.filter("differ").groupBy("k", "v").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    windows = stage(
        _same_row(docs, open_spans, "inner").mapInArrow(extend, f"k {kind}, v int, s int, a long, b int"), "substring-windows"
    )
    again = windows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    extended = windows.join(again, ["a", "b"]).select("k", "v", F.col("s").alias("lo"), F.col("s").alias("hi"))
    whole = met.filter("NOT differ").select("k", "v", "lo", "hi")
    covered = whole.unionByName(extended).select("k", "v", F.struct("lo", (F.col("hi") + length).alias("end")).alias("x"))
    return covered.groupBy("k", "v").agg(F.collect_set("x").alias("spans"))


def _mask(n: int, spans: object) -> np.ndarray:
    """Which of ``n`` words lie in one of the spans."""
    edge = np.zeros(n + 1, np.int64)
    for x in spans if spans is not None else ():
        edge[x["lo"]] += 1
        edge[x["end"]] -= 1
    return np.cumsum(edge[:-1]) > 0


def _cut_out(t: str, spans: list) -> str:
    """A text without the words of the spans; what is kept keeps its white space."""
    at = [m.span() for m in WORD.finditer(t)]
    edges = np.diff(np.concatenate(([False], _mask(len(at), spans), [False])).astype(np.int8))
    kept, start = [], 0
    for first, end in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)):
        kept.append(t[start : at[first][0]])
        start = at[end][0] if end < len(at) else len(t)
    return "".join([*kept, t[start:]])


def digests(df: DataFrame, key: str, text: str, length: int) -> DataFrame:
    """Key, n_words, n_removed and kept_sha256 of the kept words joined by one space."""
    docs = _same_row(_with_row(df, key, text, []), repeats(df, key, text, length), "left")

    def make(texts: list[str], spans: list) -> dict:
        n, gone, digest = [], [], []
        for t, s in zip(texts, spans):
            words = WORD.findall(t)
            mask = _mask(len(words), s)
            kept = words if s is None else [w for w, m in zip(words, mask.tolist()) if not m]
            n.append(len(words))
            gone.append(len(words) - len(kept))
            digest.append(hashlib.sha256(" ".join(kept).encode("utf-8", "replace")).hexdigest())
        return {"n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}

    made = with_made(docs, ["t", "spans"], lambda: make, "n_words long, n_removed long, kept_sha256 string", ["t", "spans", "v"])
    return made.withColumnRenamed("k", key)


def remove(df: DataFrame, key: str, text: str, length: int) -> DataFrame:
    """``df`` with the repeats cut out of ``text``; what is kept keeps its white space. Other columns stay."""
    rest = [c for c in df.columns if c not in (key, text)]
    docs = _same_row(_with_row(df, key, text, rest), repeats(df, key, text, length), "left")
    make = lambda texts, spans: {"kept": pa.array([_cut_out(t, s) if s else t for t, s in zip(texts, spans)], pa.string())}
    made = with_made(docs, ["t", "spans"], lambda: make, "kept string", ["t", "spans", "v"])
    return made.select(*[
        F.col("k").alias(c) if c == key else F.col("kept").alias(c) if c == text else F.col(f"_keep_{c}").alias(c) for c in df.columns
    ])
