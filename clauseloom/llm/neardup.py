"""Near-duplicate documents by ProbMinHash, banding and verification.

A document is its five-word shingles, each with a weight that grows with the logarithm of how often it occurs. Every
shingle is a Poisson process whose rate is its weight: it arrives again and again, each time at one of the signature's
components, and a component keeps the shingle that came first. Two documents agree in a component with the
probability Jaccard similarity of their weighted shingles. A shingle's process ends once its next arrival is later
than the last first arrival of all components, so most shingles arrive once or twice.

Texts with the same weighted shingles have the same signature and are one node from here on. Signatures are cut into
bands; nodes with an equal band meet in a bucket. There every node is first compared with one centre, the member whose
buckets are largest, which in a group of copies is the text they come from. Pairs are weeded by their signatures and
then verified exactly, and links make groups.

Buckets that then hold several groups are searched once more. They are cut into blocks of ``BLOCK`` members, two blocks meet in a cell, and a
task compares the signatures of a cell's members of different groups as matrices. A pair that agrees well enough is verified there and then from
the stored shingles, unless links found before it in the cell have joined the two; a pair that shares several bands is looked at in the first.
Only links leave the task, fewer than the cell has members, so very many texts that are nearly but not quite similar
make no pair rows. Every two nodes with an equal band have in the end either been compared or are in one group.

Edge cases: words are separated by white space as Python's ``str.split`` knows it; null texts and texts without words have no shingles and are classes of
their own; a text with fewer than five words is one shingle. Rows with equal keys are told apart by their texts, and a
class id is the smallest key of the class, nulls first. Repeated rows are in one class. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.common import beside, small_batches
from clauseloom.llm.components import components
from clauseloom.llm.substring import Rolling, mixed
from clauseloom.plans.stage import discard, stage

WORDS = 5
THRESHOLD = 0.8

#: 125 components in 25 bands of 5: a pair of similarity 0.8 shares no band once in 20,000 times.
BANDS, ROWS = 25, 5
COMPONENTS = BANDS * ROWS

#: Signatures that agree less are not verified: five and a half standard deviations below the threshold.
WEED = 0.6

#: Members of a bucket that are compared with each other, or with as many others, at once.
BLOCK = 512

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _step(n: int) -> np.uint64:
    """A number of its own for every arrival and every component."""
    return np.uint64(int(GOLDEN) * n % (1 << 64))


def shingles(rolling: Rolling, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of a text's shingles and their weights."""
    words = text.split()
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0)
    rolling.load(words)
    start = np.arange(max(1, len(words) - WORDS + 1))
    hashes, counts = np.unique(rolling.run(0, start, np.minimum(start + WORDS, len(words))), return_counts=True)
    return hashes, 1 + np.log(counts)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard similarity: the sum over shared i of 1 / sum over all j of max(a_j / a_i, b_j / b_i)."""
    shared, in_a, in_b = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(shared):
        return 0.0
    only_b = np.ones(len(b[0]), bool)
    only_b[in_b] = False
    x, y = a[1][in_a], b[1][in_b]
    # By falling share of a: up to a ratio the weight of a counts, beyond it that of b.
    order = np.argsort(ratio := y / x, kind="stable")
    ratio, x, y = ratio[order], x[order], y[order]
    upto = np.searchsorted(ratio, ratio, side="right")
    sum_x, sum_y = np.concatenate(([0.0], np.cumsum(x))), np.concatenate(([0.0], np.cumsum(y)))
    just_a, just_b = a[1].sum() - sum_x[-1], b[1][only_b].sum()
    return float((x / (just_a + sum_x[upto] + (sum_y[-1] - sum_y[upto] + just_b) / ratio)).sum())


def signatures(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """First-arriving shingle of every component, for many documents at once."""
    sizes = [len(h) for h, _ in sets]
    doc = np.repeat(np.arange(len(sets)), sizes)
    hashes, weights = np.concatenate([h for h, _ in sets]), np.concatenate([w for _, w in sets])
    first = np.full(len(sets) * COMPONENTS, np.inf)
    winner = np.zeros(len(sets) * COMPONENTS, np.uint64)
    at, nth = np.zeros(len(hashes)), 0
    while len(doc):
        seed = hashes + _step(2 * nth + 1)
        at = at - np.log(((mixed(seed) >> np.uint64(11)) + 0.5) * 2.0**-53) / weights
        slot = doc * COMPONENTS + (mixed(seed + GOLDEN) % np.uint64(COMPONENTS)).astype(np.int64)
        early = np.flatnonzero(at < first[slot])
        # The earliest is written last; equal times have equal hashes.
        early = early[np.argsort(-at[early], kind="stable")]
        first[slot[early]], winner[slot[early]] = at[early], hashes[early]
        running = at < first.reshape(-1, COMPONENTS).max(axis=1)[doc]
        doc, hashes, weights, at = doc[running], hashes[running], weights[running], at[running]
        nth += 1
    return winner.reshape(-1, COMPONENTS)


def bands(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key per document and band."""
    parts = mixed(signature + GOLDEN * np.arange(1, COMPONENTS + 1, dtype=np.uint64))
    return mixed(parts.reshape(len(parts), BANDS, ROWS).sum(axis=2, dtype=np.uint64)).view(np.int64)


def _sign(docs: DataFrame) -> DataFrame:
    """k, v, the node ``g``, the bands, and one byte per component; all but k and v are null in rows without words."""
    kind = docs.schema["k"].dataType.simpleString()
    made = {"a": pa.int64(), "b": pa.int64(), "bands": pa.list_(pa.int64()), "sketch": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in batches:
            sets = [shingles(rolling, t) for t in batch.column("t").to_pylist()]
            some = [i for i, s in enumerate(sets) if len(s[0])]
            if none := [i for i, s in enumerate(sets) if not len(s[0])]:
                nulls = {n: pa.nulls(len(none), t) for n, t in made.items()}
                yield beside(batch, ["k", "v"], nulls, none)
            if not some:
                continue
            sets = [sets[i] for i in some]
            signature = signatures(sets)
            whole = [[int(mixed(mixed(h + np.uint64(i)) ^ w.view(np.uint64)).sum(dtype=np.uint64)) for i in (1, 2)] for h, w in sets]
            g = np.array(whole, np.uint64).view(np.int64)
            yield beside(batch, ["k", "v"], {
                "a": g[:, 0], "b": g[:, 1], "bands": pa.array(list(bands(signature)), made["bands"]),
                "sketch": pa.array([x.tobytes() for x in signature.astype(np.uint8)], pa.binary()),
            }, some)

    v = docs.schema["v"].dataType.simpleString()
    signed = docs.mapInArrow(run, f"k {kind}, v {v}, a long, b long, bands array<long>, sketch binary")
    return signed.select("k", "v", F.when(F.col("a").isNotNull(), F.struct("a", "b")).alias("g"), "bands", "sketch")


def _starred(members: DataFrame) -> DataFrame:
    """``members`` (bucket, band, id) of buckets with more than one, with the bucket's size ``n`` and its ``centre``."""
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = stage(members.join(sizes, "bucket"), "buckets")
    known = shared.groupBy("id").agg(F.sum("n").alias("weight"))
    centres = shared.join(known, "id").groupBy("bucket").agg(F.max(F.struct("weight", "id"))["id"].alias("centre"))
    out = stage(shared.join(centres, "bucket"), "stars")
    discard(shared)
    return out


def _alike(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures agree well enough."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                one, two = (np.frombuffer(b"".join(batch[c]), np.uint8).reshape(-1, COMPONENTS) for c in ("s1", "s2"))
                yield batch.loc[(one == two).mean(axis=1) >= WEED, ["a", "b"]]

    both = pairs.join(signed.selectExpr("id AS a", "sketch AS s1"), "a").join(signed.selectExpr("id AS b", "sketch AS s2"), "b")
    return both.mapInPandas(run, "a long, b long")


def _shingled(needed: DataFrame, signed: DataFrame, docs: DataFrame) -> DataFrame:
    """id, hashes and counts of the shingles of the nodes in ``needed`` (id), from one row of each."""
    rows = needed.distinct().join(signed.selectExpr("id", "k AS _k", "v AS _v"), "id")
    on = docs["k"].eqNullSafe(rows["_k"]) & (docs["v"] == rows["_v"])
    # Rows of equal key and text may come twice.
    texts = docs.join(rows, on).groupBy("id").agg(F.first("t").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in batches:
            sets = [shingles(rolling, t) for t in batch.column("t").to_pylist()]
            yield beside(batch, ["id"], {
                "hashes": pa.array([h.tobytes() for h, _ in sets], pa.binary()), "weights": pa.array([w.astype(np.float64).tobytes() for _, w in sets], pa.binary()),
            })

    return stage(texts.mapInArrow(run, "id long, hashes binary, weights binary"), "neardup-shingles")


def _set(hashes: bytes, weights: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(hashes, np.uint64), np.frombuffer(weights, np.float64)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose weighted shingles are similar."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = [similarity(_set(x, y), _set(z, w)) >= THRESHOLD - 1e-9 for x, y, z, w in zip(batch["h1"], batch["w1"], batch["h2"], batch["w2"])]
            yield batch.loc[np.array(good, bool), ["a", "b"]]

    both = pairs.join(sets.selectExpr("id AS a", "hashes AS h1", "weights AS w1"), "a").join(sets.selectExpr("id AS b", "hashes AS h2", "weights AS w2"), "b")
    return both.mapInPandas(run, "a long, b long")


class _Groups:
    """Groups of labels that links have joined."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def of(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x


def _cell(cell: pd.DataFrame) -> list[tuple[int, int]]:
    """Links (a, b) between different groups of a cell's members that no links found before have joined."""
    m, crossing = len(cell), bool((cell["lo"] != cell["hi"]).iloc[0])
    ids, labels, side = cell["id"].to_numpy(), cell["label"].tolist(), (cell["block"] == cell["hi"]).to_numpy() if crossing else np.zeros(m, bool)
    band = int(cell["band"].iloc[0])
    sketch = np.frombuffer(b"".join(cell["sketch"]), np.uint8).reshape(m, -1)
    earlier = np.stack(cell["bands"].to_numpy())[:, :band]
    sets = [_set(h, w) for h, w in zip(cell["hashes"], cell["weights"])]
    groups, links = _Groups(), []
    own = np.array(labels)
    for i in range(m - 1):
        ahead = np.arange(i + 1, m)
        ahead = ahead[(own[ahead] != own[i]) & (side[ahead] != side[i] if crossing else True)]
        share = (sketch[ahead] == sketch[i]).mean(axis=1)
        ahead, share = ahead[share >= WEED], share[share >= WEED]
        if band and len(ahead):
            first = ~(earlier[ahead] == earlier[i]).any(axis=1)
            ahead, share = ahead[first], share[first]
        for j in ahead[np.argsort(-share, kind="stable")].tolist():
            x, y = groups.of(labels[i]), groups.of(labels[j])
            if x != y and similarity(sets[i], sets[j]) >= THRESHOLD - 1e-9:
                groups.up[x] = y
                links.append((int(ids[i]), int(ids[j])))
    return links


def _across(members: DataFrame, labels: DataFrame | None, signed: DataFrame, docs: DataFrame) -> DataFrame | None:
    """Links (a, b) between members (bucket, band, id, n) of different groups; none if no bucket holds several groups."""
    group = F.col("id")
    if labels is not None:
        members, group = members.join(labels.withColumnRenamed("node", "id"), "id", "left"), F.coalesce("label", "id")
    members = members.select("bucket", "band", "id", "n", group.alias("label"))
    several = members.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("bucket")
    rest = stage(members.join(several, "bucket"), "rest")
    if rest.isEmpty():
        return None
    shingled = _shingled(rest.select("id"), signed, docs)
    sets = shingled.join(signed.select("id", "bands", "sketch"), "id")
    blocks = f"CAST((n + {BLOCK - 1}) DIV {BLOCK} AS INT)"
    placed = rest.selectExpr("*", f"CAST(pmod(xxhash64(id, band), {blocks}) AS INT) AS block").selectExpr("*", f"explode(sequence(0, {blocks} - 1)) AS other")
    cells = placed.selectExpr("bucket", "band", "least(block, other) AS lo", "greatest(block, other) AS hi", "block", "id", "label").join(sets, "id")
    met = cells.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, []
        for batch in batches:
            for where, part in batch.groupby(["bucket", "lo", "hi"], sort=False):
                if where != at and held:
                    yield pd.DataFrame(_cell(pd.concat(held)), columns=["a", "b"])
                    held = []
                at = where
                held.append(part)
        if held:
            yield pd.DataFrame(_cell(pd.concat(held)), columns=["a", "b"])

    found = stage(met.mapInPandas(run, "a long, b long").distinct(), "across")
    discard(rest, shingled)
    return found


def _links(signed: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame | None:
    """``node`` and ``label`` of all nodes that are similar to another one; none if there are no such nodes.

    ``signed`` has a row (g, k, v, bands, sketch) per node. From here on a node is a number of eight bytes.
    """
    signed = signed if "id" in signed.columns else stage(signed.withColumn("id", F.monotonically_increasing_id()), "numbered")
    starred = _starred(signed.select("id", F.posexplode("bands").alias("band", "bucket")))
    alike = stage(_alike(starred.filter("id <> centre").selectExpr("id AS a", "centre AS b").distinct(), signed), "alike")
    sets = _shingled(alike.selectExpr("explode(array(a, b)) AS id"), signed, docs)
    links = stage(_verified(alike, sets), "similar")
    discard(alike, sets)
    labels = None if links.isEmpty() else components(links)
    more = _across(starred.select("bucket", "band", "id", "n"), labels, signed, docs)
    if more is not None and not more.isEmpty():
        labels = components(links.unionByName(more))
    discard(starred)
    if labels is None:
        return None
    own = signed.select("id", F.col("g").alias("node")).join(labels.withColumnRenamed("node", "id"), "id").select("node", F.col("label").alias("id"))
    return own.join(signed.select("id", F.col("g").alias("label")), "id").select("node", "label")


def classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per row of ``df``: ``k``, ``v`` (tells rows of equal key apart), class_id, representative, class_size."""
    small_batches(df.sparkSession)
    docs = df.select(F.col(key).alias("k"), F.xxhash64(F.col(text)).alias("v"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = stage(_sign(docs), "signatures")
    # A node's signature is the same in every one of its rows.
    with_words = rows.filter("g IS NOT NULL")
    first = with_words.groupBy("g").agg(F.min(F.struct("k", "v", "bands", "sketch")).alias("r")).select("g", "r.*")
    signed = stage(first.withColumn("id", F.monotonically_increasing_id()), "nodes")
    nodes = signed.select("g", "k", "v")
    labels = _links(signed, nodes, docs)
    of_row = with_words.select("k", "v", "g")
    if labels is None:
        of_row = of_row.withColumn("label", F.col("g"))
    else:
        of_row = of_row.join(labels.withColumnRenamed("node", "g"), "g", "left").withColumn("label", F.coalesce("label", "g"))
    of_row, alone = stage(of_row.drop("g"), "labelled"), stage(rows.filter("g IS NULL").select("k", "v"), "wordless")
    discard(rows, signed)
    heads = of_row.groupBy("label").agg(F.min(F.struct("k", "v")).alias("head"), F.count(F.lit(1)).alias("class_size"))
    found = of_row.join(heads, "label").select(
        "k", "v", F.col("head.k").alias("class_id"), (F.struct("k", "v") == F.col("head")).alias("representative"), "class_size"
    )
    wordless = alone.select(
        "k", "v", F.col("k").alias("class_id"), F.lit(True).alias("representative"), F.lit(1).cast("long").alias("class_size")
    )
    return found.unionByName(wordless)


def keep_one(df: DataFrame, key: str, text: str) -> DataFrame:
    """``df`` with one row of each class: that with the smallest key. Rows without words stay."""
    kept = classes(df, key, text).filter("representative").groupBy("k", "v").agg(F.max("class_size").alias("_kept_n"))
    kept = kept.withColumnsRenamed({"k": "_kept_k", "v": "_kept_v"})
    docs = df.withColumn("_kept_hash", F.xxhash64(F.col(text)))
    on = docs[key].eqNullSafe(kept["_kept_k"]) & (docs["_kept_hash"] == kept["_kept_v"])
    out = docs.join(kept, on)
    # Only a class of more than one row can hold the same row twice.
    alone = out.filter("_kept_n = 1")
    several = out.filter("_kept_n > 1").dropDuplicates([key, "_kept_hash"])
    return alone.unionByName(several).select(*df.columns)
