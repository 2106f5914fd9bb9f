"""Vector search, graph expansion and context assembly for a batch of queries.

A small batch of queries goes to every task as one matrix: vectors are scanned where they lie, a task keeps the best
``k`` per query of all it reads, and only those rows are shuffled. Larger batches meet the vectors in the cells of a grid
(:func:`_grid`): blocks of queries by blocks of vectors, each read once however many queries there are. No query-vector pair is
ever a row, and neither the broadcast nor the driver depends on how many queries there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.functions import ids
from clauseloom.operators import structure as st
from clauseloom.plans.bounded import bounded_rows
from clauseloom.plans.ordered import SEGMENT_ROWS, ordinal, rank_all, segment_of, spread, top_per_key
from clauseloom.plans.stage import stage

#: Queries whose vectors travel together; 4,096 of 384 doubles are 12 MB.
QUERY_BLOCK = 4096


def embedding_text(chunks: DataFrame, passage_chars: int = 8000, kept_chars: int | None = None) -> DataFrame:
    """The text a clause is embedded by and the payload kept with it, the passage or its first ``kept_chars`` characters.

    A text of more than ``passage_chars`` characters goes on in further rows, numbered by ``passage`` from 0.
    """
    return (
        st.text_passages(chunks, passage_chars)
        .filter("btrim(text) <> ''")
        .selectExpr(
            "document_id", "chunk_id", "passage", f"{ids.clause_uid('document_id', 'chunk_id')} AS uid", "title",
            "text AS embed_text", f"substring(text, 1, {int(passage_chars if kept_chars is None else kept_chars)}) AS content",
        )
    )


def hashing_encoder(dim: int = 384) -> Callable[[DataFrame, str], DataFrame]:
    """The offline encoder: hashed term counts of unit length, by built-in ML stages."""
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    def encode(df: DataFrame, col: str) -> DataFrame:
        words = df.selectExpr("*", rf"filter(split(lower({col}), r'\s+'), w -> w <> '') AS _words")
        counted = HashingTF(numFeatures=dim, inputCol="_words", outputCol="_tf").transform(words)
        unit = Normalizer(p=2.0, inputCol="_tf", outputCol="_unit").transform(counted)
        return unit.withColumn("embedding", vector_to_array("_unit", "float32")).drop("_words", "_tf", "_unit")

    return encode


def model_encoder(load: Callable[[], Callable[[list[str]], list]]) -> Callable[[DataFrame, str], DataFrame]:
    """An encoder around an outside model. ``load`` runs once per task and returns texts -> vectors."""

    def encode(df: DataFrame, col: str) -> DataFrame:
        @F.pandas_udf("array<float>")
        def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for texts in batches:
                yield pd.Series([np.asarray(v, dtype="float32") for v in model(list(texts))], index=texts.index)

        return df.withColumn("embedding", vectors(F.col(col)))

    return encode


def embed_chunks(texts: DataFrame, encoder=None) -> DataFrame:
    """Rows of :func:`embedding_text` with their vector."""
    encode = encoder or hashing_encoder()
    return encode(texts, "embed_text").drop("embed_text")


def usable(df: DataFrame) -> DataFrame:
    """Rows whose ``embedding`` is there and holds finite numbers only."""
    return df.filter("embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf'))")


def one_per_query(queries: DataFrame) -> DataFrame:
    """One usable row per ``query_id``, so blocks that are cut by its hash always get smaller."""
    rest = [c for c in queries.columns if c not in ("query_id", "embedding")]
    first = F.min(F.struct("embedding", *rest)).alias("r")
    return usable(queries).groupBy("query_id").agg(first).select("query_id", "r.*").select(*queries.columns)


def _lengths(m: np.ndarray) -> np.ndarray:
    return np.sqrt((m * m).sum(axis=1))


def _unit(m: np.ndarray) -> np.ndarray:
    norm = _lengths(m)[:, None]
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _rough(m: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Rows at unit length in single precision; what double precision cannot hold well becomes NaN."""
    with np.errstate(all="ignore"):
        unit = np.divide(m, length[:, None], out=np.zeros_like(m), where=length[:, None] > 0)
        unit[~np.isfinite(length) | ((length > 0) & (length < 1e-140))] = np.nan
        return unit.astype("float32")


class _Best:
    """The best ``k`` vectors per query of those it has seen.

    Queries go in blocks past pieces of the vectors. A product in single precision tells which pairs may reach a query's ``k``-th score, by
    a bound on its error; only these are scored in double precision and merged. With ``ordered`` vectors come by ascending key, so a
    score that ties with the ``k``-th changes nothing.
    """

    #: Pairs of one product.
    PAIRS = 1_000_000

    def __init__(self, queries: np.ndarray, qid: np.ndarray, k: int, block: int = 256, ordered: bool = False):
        self.q, self.length, self.qid, self.k, self.ordered = queries, _lengths(queries), qid, k, ordered
        self.block, self.unit, self.seen = max(1, min(block, 256)), _rough(queries, self.length), 0
        self.score, self.key = np.full((len(qid), k), -np.inf), np.empty((len(qid), k), dtype=object)
        self.error = np.float32((queries.shape[1] + 16) * 1.2e-7)

    def see(self, vectors: np.ndarray, keys: np.ndarray) -> None:
        part = vectors.astype("float64", copy=False)
        length = _lengths(part)
        unit = _rough(part, length)
        fine, largest, at = not (np.isnan(unit).any() or np.isnan(self.unit).any()), max(1, self.PAIRS // self.block), 0
        while at < len(keys):
            # Short pieces first: each may at most double what a query has seen.
            cut = slice(at, at + min(largest, max(4 * self.k, self.seen)))
            for i in range(0, len(self.qid), self.block):
                self._meet(slice(i, i + self.block), part[cut], length[cut], unit[cut], keys[cut], fine)
            self.seen += len(keys[cut])
            at = cut.stop

    def _meet(self, rows: slice, part: np.ndarray, length: np.ndarray, unit: np.ndarray, keys: np.ndarray, fine: bool) -> None:
        least = self.score[rows, -1]
        floor = least.astype("float32") - self.error
        if self.ordered:
            # Every score of an empty query is 0.
            floor[(self.length[rows] == 0) & (least == 0)] = np.inf
        product = self.unit[rows] @ unit.T
        # NaN is never below a floor.
        likely = np.flatnonzero(product >= floor[:, None] if fine else ~(product < floor[:, None]))
        for i in range(0, len(likely), self.PAIRS // 4):
            r, c = np.divmod(likely[i : i + self.PAIRS // 4], len(keys))
            score = np.empty(len(r))
            step = max(1, self.PAIRS // part.shape[1])
            for j in range(0, len(r), step):
                # Products before lengths: whole numbers then give equal scores for equal vectors wherever they stand.
                a, b = r[j : j + step], c[j : j + step]
                both = self.length[rows][a] * length[b]
                dot = np.einsum("ij,ij->i", self.q[rows][a], part[b])
                score[j : j + step] = np.divide(dot, both, out=np.zeros(len(a)), where=both > 0)
            least = self.score[rows, -1][r]
            hit = np.isfinite(score) & ((score > least) if self.ordered else (score >= least))
            if hit.any():
                self._merge(r[hit] + rows.start, score[hit], keys[c[hit]])

    def _merge(self, r: np.ndarray, score: np.ndarray, keys: np.ndarray) -> None:
        rows = np.unique(r)
        r = np.concatenate([np.repeat(rows, self.k), r])
        score = np.concatenate([self.score[rows].ravel(), score])
        keys = np.concatenate([self.key[rows].ravel(), keys])
        # Earlier ones have the smaller keys if vectors come in their order; a key that is null is the smallest.
        tie = np.arange(len(r)) if self.ordered else pd.factorize(keys, sort=True)[0]
        order = np.lexsort((tie, -score, r))
        starts = np.searchsorted(r[order], rows)
        kept = order[(starts[:, None] + np.arange(self.k)).ravel()]
        self.score[rows], self.key[rows] = score[kept].reshape(-1, self.k), keys[kept].reshape(-1, self.k)

    def rows(self, key: str) -> pd.DataFrame:
        hit = np.isfinite(self.score)
        row, _ = np.nonzero(hit)
        return pd.DataFrame({"query_id": self.qid[row], key: self.key[hit], "score": self.score[hit]})


class _BestOf:
    """:class:`_Best` by the value that queries ask for; those without one ask for all."""

    def __init__(self, queries: np.ndarray, qid: np.ndarray, k: int, wanted: np.ndarray | None = None, block: int = 256, ordered: bool = False):
        asked = pd.Series([None] * len(qid) if wanted is None else wanted, dtype=object)
        made = lambda at: _Best(queries[at], qid[at], k, block, ordered)
        self.anything = made(np.flatnonzero(asked.isna()))
        self.asking = {value: made(at.to_numpy()) for value, at in pd.Series(np.arange(len(asked))).groupby(asked)}

    def see(self, vectors: np.ndarray, keys: np.ndarray, have: np.ndarray | None = None) -> None:
        if len(self.anything.qid):
            self.anything.see(vectors, keys)
        if self.asking:
            for value, at in pd.Series(np.arange(len(keys))).groupby(pd.Series(have, dtype=object)):
                if value in self.asking:
                    self.asking[value].see(vectors[at.to_numpy()], keys[at.to_numpy()])

    def rows(self, key: str) -> pd.DataFrame:
        return pd.concat([best.rows(key) for best in (self.anything, *self.asking.values())], ignore_index=True)


def _stacked(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy())


def _scan(vectors: DataFrame, rows: list, k: int, key: str, match: str | None) -> DataFrame:
    """Best ``k`` vectors per query of a batch that every task gets, by task."""
    q = np.array([r["embedding"] for r in rows], dtype="float64")
    qid = np.array([r["query_id"] for r in rows], dtype="int64")
    wanted = np.array([r[match] for r in rows], dtype=object) if match else None
    cast = vectors.schema[key].dataType.simpleString()
    shared = vectors.sparkSession.sparkContext.broadcast((q, qid, wanted))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q, qid, wanted = shared.value
        best = _BestOf(q, qid, k, wanted)
        for pdf in batches:
            if len(pdf):
                best.see(_stacked(pdf["embedding"]), pdf[key].to_numpy(dtype=object), pdf[match].to_numpy(dtype=object) if match else None)
        yield best.rows(key)

    columns = list(dict.fromkeys([key, "embedding", *([match] if match else [])]))
    return vectors.select(*columns).mapInPandas(search, f"query_id long, {key} {cast}, score double")


#: Vectors of a cell of the grid, about; bytes of a cell's queries and what is found for them; and buckets that values of the filter
#: column fall into.
CELL_VECTORS, CELL_BYTES, MATCH_BUCKETS = 262_144, 16 << 20, 1024
#: Copies of the vectors that are shuffled at once; more groups of queries take more rounds.
COPIES = 2


def _numbers(df: DataFrame) -> str:
    """The narrower of the two array types that vectors are compared from."""
    return "array<float>" if df.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"


def in_cells(
    queries: DataFrame, vectors: DataFrame, k: int, key: str, match: str | None = None, codes: str | None = None,
    decode: Callable[[str, pd.Series], np.ndarray] | None = None, block: int = 256,
) -> DataFrame:
    """Best ``k`` vectors per query within each cell.

    ``queries(cell, query_id, embedding)`` and ``vectors(cell, key, embedding)``, both with ``match`` if there is one, are brought
    together by cell. A task reads a cell's queries, which must be few, and lets its vectors pass by in batches, past ``block`` queries at a
    time. Vectors may come as bytes in a column ``codes`` instead, which ``decode`` turns into a matrix for a cell.
    """
    cast = vectors.schema[key].dataType.simpleString()
    extra = [F.col(match).cast("string").alias("_match")] if match else []
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    kind = _numbers(queries) if codes or _numbers(queries) == _numbers(vectors) else "array<double>"
    held_v = none(kind, "_v") if codes else F.col("embedding").cast(kind).alias("_v")
    asks = queries.select("cell", F.lit(0).alias("_side"), "query_id", none(cast, "_key"), F.col("embedding").cast(kind).alias("_v"), none("binary", "_code"), *extra)
    held = vectors.select("cell", F.lit(1).alias("_side"), none("long", "query_id"), F.col(key).alias("_key"), held_v, F.col(codes).alias("_code") if codes else none("binary", "_code"), *extra)
    # Cells are few bytes for much work, so their number of partitions must not shrink with the bytes.
    partitions = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = asks.unionByName(held).repartition(partitions, "cell").sortWithinPartitions("cell", "_side", "_key")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, asked, best = None, [], None
        for batch in batches:
            for (cell, side), pdf in batch.groupby(["cell", "_side"], sort=True):
                if cell != at:
                    if best is not None:
                        yield best.rows(key)
                    at, asked, best = cell, [], None
                if side == 0:
                    asked.append((_stacked(pdf["_v"]), pdf["query_id"].to_numpy("int64"), pdf["_match"].to_numpy(dtype=object) if match else None))
                elif asked:
                    if best is None:
                        q, qid, wanted = ([x[i] for x in asked] for i in range(3))
                        best = _BestOf(np.concatenate(q).astype("float64"), np.concatenate(qid), k, np.concatenate(wanted) if match else None, block, True)
                        asked = [None]
                    best.see(decode(cell, pdf["_code"]) if decode else _stacked(pdf["_v"]), pdf["_key"].to_numpy(dtype=object), pdf["_match"].to_numpy(dtype=object) if match else None)
        if best is not None:
            yield best.rows(key)

    return met.mapInPandas(search, f"query_id long, {key} {cast}, score double")


def _grid(queries: DataFrame, vectors: DataFrame, n: int, k: int, key: str, match: str | None, block: int) -> DataFrame:
    """Best ``k`` vectors per query and slice of vectors, for any number of queries.

    Queries are cut into groups of about ``CELL_BYTES`` by hash, vectors into slices of at most about ``CELL_VECTORS``; each pair of them is
    a cell, whose queries are searched in blocks. A vector goes to as many cells as there are groups, a query to as many as there are
    slices. With a filter the value's bucket is part of the cell: a vector then meets only the queries of its bucket and those
    that search all.

    Groups are taken ``COPIES`` at a time, each time with one read of the vectors, so that what is shuffled at once does not grow with
    the number of queries.
    """
    home = F.pmod(F.xxhash64(F.col(match).cast("string")), F.lit(MATCH_BUCKETS)).cast("int") if match else F.lit(-1)
    queries = queries.withColumn("bucket", F.when(F.col(match).isNotNull(), home).otherwise(-1) if match else home)
    # At most one row per bucket of values comes to the driver.
    counted = queries.groupBy("bucket").agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim")).collect()
    sizes = {r["bucket"]: -(-r["n"] * (8 * r["dim"] + 16 * k) // CELL_BYTES) for r in counted}
    # Enough cells for all cores, as far as slices of 4,096 vectors and a few copies of the queries go.
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    slices = max(1, -(-n // CELL_VECTORS), min(n // 4096, -(-3 * cores // sum(sizes.values()))))
    blocks = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])
    every = queries.withColumn("part", F.pmod(F.xxhash64("query_id", F.lit(11)), blocks[F.col("bucket")]))
    to = F.array_distinct(F.array(F.lit(-1), F.coalesce(home, F.lit(-1)))) if match else F.array(F.lit(-1))
    copies = max((n for b, n in sizes.items() if b >= 0), default=0) + sizes.get(-1, 0)
    rounds = -(-copies // COPIES)
    more = [match] if match else []
    columns = list(dict.fromkeys([key, "embedding", *more]))
    cell = F.concat_ws("/", "bucket", "part", "slice").alias("cell")

    def searched(turn: int) -> DataFrame:
        asked = every.filter(F.col("part") % rounds == turn).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
        held = (
            vectors.withColumn("slice", F.pmod(F.xxhash64(key, F.lit(13)), F.lit(slices)))
            .withColumn("bucket", F.explode(to)).withColumn("_parts", blocks[F.col("bucket")]).filter(f"_parts > {turn}")
            .withColumn("part", F.explode(F.sequence(F.lit(turn), F.col("_parts") - 1, F.lit(rounds))))
        )
        return in_cells(asked.select(cell, "query_id", "embedding", *more), held.select(cell, *columns), k, key, match, block=block)

    if rounds <= 1:
        return searched(0)
    # What a round finds is written, so that its copies go before the next.
    return reduce(DataFrame.unionByName, [stage(top_per_key(searched(turn), ["query_id"], ["score DESC", key], k).drop("rank"), "round") for turn in range(rounds)])


def vector_search(
    queries: DataFrame, vectors: DataFrame, k: int = 5, key: str = "vec_id", match: str | None = None, block: int | None = None
) -> DataFrame:
    """Exact cosine top-k: ``query_id, <key>, score, rank``.

    ``match`` names a payload column that must equal the query's value; a query with null there searches all.
    Vectors and queries that are null or hold null or non-finite numbers take no part. Of query rows with one id the
    one with the smallest vector asks. The vectors are read once by tasks that all have the queries if there are at most
    ``block``, else by the cells of a grid, once for each ``COPIES`` groups of queries.
    """
    queries, every, vectors, block = one_per_query(queries), vectors, usable(vectors), block or QUERY_BLOCK
    rows = bounded_rows(queries, block)
    if rows is None:
        # Counting needs no column of the vectors.
        found = _grid(stage(queries, "queries"), vectors, every.count(), k, key, match, block)
    elif rows:
        found = _scan(vectors, rows, k, key, match)
    else:
        return vectors.sparkSession.createDataFrame([], f"query_id long, {key} {vectors.schema[key].dataType.simpleString()}, score double, rank int")
    return top_per_key(found, ["query_id"], ["score DESC", key], k)


def search_clauses(questions: DataFrame, embedded: DataFrame, k: int = 5, by_clause: bool = False) -> DataFrame:
    """The clauses of the ``k`` passages nearest to each question, as seeds for :func:`anchor_expand`.

    ``questions(query_id, embedding)`` against rows of :func:`embed_chunks`. A clause with several passages among the
    ``k`` comes once, with its nearest one, so there may be fewer clauses than ``k``; with ``by_clause`` further passages
    are read until there are ``k`` clauses or no more passages.
    """
    rows = stage(embedded.selectExpr("concat(uid, '#', passage) AS passage_uid", "uid", "document_id", "title", "content", "embedding"), "passages")
    vectors, clauses = rows.select("passage_uid", "embedding"), rows.select("passage_uid", "uid").distinct()
    # Texts wait until it is known which passages are kept.
    found = vector_search(questions, vectors, k, "passage_uid").join(clauses, "passage_uid")
    if by_clause:
        parts, depth = [], k
        while True:
            found = stage(found, "found")
            short = stage(
                found.groupBy("query_id").agg(F.countDistinct("uid").alias("clauses"), F.count(F.lit(1)).alias("n"))
                .filter(f"clauses < {k} AND n = {depth}").select("query_id"), "short")
            parts.append(found.join(short, "query_id", "left_anti"))
            if short.isEmpty():
                break
            questions, depth = questions.join(short, "query_id"), depth * 4
            deeper = vector_search(questions, vectors, depth, "passage_uid", block=max(1, QUERY_BLOCK * k // depth))
            found = deeper.join(clauses, "passage_uid")
        found = reduce(DataFrame.unionByName, parts)
    nearest = found.groupBy("query_id", "uid").agg(F.expr("min_by(struct(score, passage_uid, rank AS at), rank)").alias("x"))
    seeds = top_per_key(nearest.select("query_id", "uid", "x.*"), ["query_id"], ["at"], k)
    texts = rows.groupBy("passage_uid", "uid").agg(F.expr("min(struct(document_id, title, content))").alias("t"))
    return seeds.join(texts, ["passage_uid", "uid"]).select("query_id", "uid", "score", "t.*", "rank")


def answer_context(
    questions: DataFrame, texts: DataFrame, nodes: DataFrame, edges: DataFrame, encoder=None, k: int = 5, n: int = 5, form: str = "plain",
    by_clause: bool = False,
) -> DataFrame:
    """``query_id, context``: from ``questions(query_id, text)`` to the text an answer is to be grounded in.

    Questions and the rows of :func:`embedding_text` go through one encoder; the nearest clauses bring their neighbours
    in the graph, and the first ``n`` of both make the context.
    """
    encode = encoder or hashing_encoder()
    asked = encode(questions.select("query_id", "text"), "text").select("query_id", "embedding")
    seeds = stage(search_clauses(asked, embed_chunks(texts, encode), k, by_clause), "seeds")
    return assemble_context(anchor_expand(seeds, nodes, edges), n, form)


# The default titles of graph neighbours.
_PARENT, _CHILD, _REFERENCE, _TABLE, _FIGURE = "Parent Section", "Sub-section", "Referenced Section", "Data Table", "Diagram"


_NEAR_DOCUMENT = "CASE WHEN rel_rank <= 2 AND contains(seed_uid, ':') THEN split(seed_uid, ':')[1] ELSE '' END"
_NEAR_TITLE = (
    f"CASE rel_rank WHEN 4 THEN concat('Table ', {{n}}table_number, ': ', coalesce(nullif({{n}}caption, ''), '{_TABLE}'))"
    f" WHEN 5 THEN concat('Figure ', {{n}}figure_number, ': ', coalesce(nullif({{n}}caption, ''), '{_FIGURE}'))"
    f" ELSE coalesce(nullif({{n}}title, ''), CASE rel_rank WHEN 1 THEN '{_PARENT}' WHEN 2 THEN '{_CHILD}' ELSE '{_REFERENCE}' END) END"
)
_NEAR_CONTENT = (
    "CASE rel_rank WHEN 4 THEN concat('[Table ', {n}table_number, ' - See source document]')"
    " WHEN 5 THEN concat('[Figure ', {n}figure_number, ' - See source document]')"
    " ELSE coalesce({n}content_text, '') END"
)


def _links(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """``query_id, seed_uid, seed_rank, n_uid, rel_rank``: each edge at a seed that its context follows."""
    s = seeds.selectExpr("query_id", "uid AS seed_uid", "rank AS seed_rank")
    down = edges.filter("rel_type IN ('CONTAINS', 'REFERS_TO', 'REFERENCES', 'HAS_TABLE', 'HAS_FIGURE')").selectExpr(
        "source_uid AS seed_uid", "target_uid AS n_uid",
        "CASE rel_type WHEN 'CONTAINS' THEN 2 WHEN 'HAS_TABLE' THEN 4 WHEN 'HAS_FIGURE' THEN 5 ELSE 3 END AS rel_rank",
    )
    up = edges.filter("rel_type = 'CONTAINS'").selectExpr("target_uid AS seed_uid", "source_uid AS n_uid", "1 AS rel_rank")
    return s.join(up.unionByName(down), "seed_uid")


def _node_texts(nodes: DataFrame) -> DataFrame:
    return nodes.selectExpr(
        "uid AS n_uid", "label",
        *[c if c in nodes.columns else f"CAST(NULL AS STRING) AS {c}" for c in ("title", "content_text", "caption", "table_number", "figure_number")],
    )


def expand_context(seeds: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Graph neighbours of each seed ``(query_id, uid, ...)``, one hop: parents, children, references,
    tables and figures. ``rel_rank`` keeps that order."""
    return _links(seeds, edges).join(_node_texts(nodes), "n_uid").selectExpr(
        "query_id", "seed_uid", "seed_rank", "rel_rank", "n_uid AS uid", f"{_NEAR_DOCUMENT} AS document_id",
        f"{_NEAR_TITLE.replace('{n}', '')} AS title", f"{_NEAR_CONTENT.replace('{n}', '')} AS content", "label AS node_type",
    )


def anchor_expand(seeds: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Seeds, then their neighbours; the first occurrence of a uid stays.

    ``seeds(query_id, uid, rank, score, document_id, title, content)``. A seed keeps its score; a neighbour
    has retrieval score 0.5 and score 0. ``rank`` numbers the context of a query from 1; neighbours of one
    seed and relation stand in a fixed hashed order, which lets the numbering split a hot query. Texts join the numbered rows.
    """
    own = seeds.selectExpr("query_id", "uid", "false AS is_expansion", "rank AS seed_rank", "0 AS rel_rank", "document_id")
    near = _links(seeds, edges).join(nodes.selectExpr("uid AS n_uid").distinct(), "n_uid")
    more = near.selectExpr("query_id", "n_uid AS uid", "true AS is_expansion", "seed_rank", "rel_rank", f"{_NEAR_DOCUMENT} AS document_id")
    first = (
        own.unionByName(more)
        .groupBy("query_id", "uid")
        .agg(F.expr("min(struct(is_expansion, seed_rank, rel_rank, document_id))").alias("x"))
        .selectExpr("query_id", "uid", "x.*", f"{spread('uid')} AS _spread")
    )
    numbered = ordinal(
        stage(first, "first"), ["query_id"], ["is_expansion", "seed_rank", "rel_rank", "_spread"], ["uid"], "rank"
    )
    ranked = stage(numbered.drop("_spread"), "ranked")
    place = ("query_id", "uid", "is_expansion", "seed_rank", "rel_rank", "document_id")
    told = seeds.selectExpr("query_id AS _q", "uid AS _u", "rank AS _r", "document_id AS _d", "struct(title, content, CAST(score AS DOUBLE) AS score) AS t")
    told = told.groupBy("_q", "_u", "_r", "_d").agg(F.min("t").alias("t"))
    kept = ranked.filter("NOT is_expansion").join(told, F.expr("query_id <=> _q AND uid <=> _u AND seed_rank <=> _r AND document_id <=> _d"))
    kept = kept.selectExpr(*place, "t.title AS title", "t.content AS content", "'Clause' AS node_type", "t.score AS score", "t.score AS retrieval_score", "rank")
    # Nodes of one uid are at most as many as there are labels.
    named = _node_texts(nodes).groupBy("n_uid").agg(F.expr("collect_list(struct(label, title, content_text, caption, table_number, figure_number))").alias("_nodes"))
    here = lambda text: text.replace("{n}", "n.")
    least = f"array_min(transform(_nodes, n -> struct({here(_NEAR_TITLE)} AS title, {here(_NEAR_CONTENT)} AS content, n.label AS node_type)))"
    found = ranked.filter("is_expansion").join(named, F.expr("uid = n_uid")).selectExpr(*place, "rank", f"{least} AS t")
    return kept.unionByName(found.selectExpr(*place, "t.*", "0.0D AS score", "0.5D AS retrieval_score", "rank"))


def graph_expand(uids: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Title, text, neighbours and counts of each asked clause, as one row per clause and one per neighbour.

    ``relation`` is ``self``, ``parent`` or ``child``; counts stand in the ``self`` row. Each relation is
    aggregated on its own, so they never multiply.
    """
    clauses = nodes.filter("label = 'Clause'").select("uid", "clause_id", "title", "content_text")
    asked = uids.select("uid").distinct().join(clauses, "uid")
    count = (
        edges.filter("rel_type IN ('HAS_TABLE', 'HAS_FIGURE')")
        .groupBy(F.col("source_uid").alias("uid"))
        .agg(F.expr("count_if(rel_type = 'HAS_TABLE')").alias("tables"), F.expr("count_if(rel_type = 'HAS_FIGURE')").alias("figures"))
    )
    own = asked.join(count, "uid", "left").selectExpr(
        "uid", "'self' AS relation", "clause_id AS id", "title", "content_text AS content",
        "coalesce(tables, 0) AS tables", "coalesce(figures, 0) AS figures",
    )
    contains = edges.filter("rel_type = 'CONTAINS'").select("source_uid", "target_uid").distinct()

    def near(here: str, there: str, relation: str) -> DataFrame:
        links = asked.select("uid").join(contains, F.expr(f"uid = {here}")).selectExpr("uid", f"{there} AS n_uid")
        named = clauses.selectExpr("uid AS n_uid", "clause_id AS id", "title")
        return links.join(named, "n_uid").selectExpr("uid", f"'{relation}' AS relation", "id", "title")

    return own.unionByName(near("source_uid", "target_uid", "child"), allowMissingColumns=True).unionByName(
        near("target_uid", "source_uid", "parent"), allowMissingColumns=True
    )


def hybrid_fuse(vector: DataFrame, graph: DataFrame, alpha: float = 0.6, method: str = "weighted", rrf: int = 60) -> DataFrame:
    """Two result lists ``(query_id, uid, score, rank)`` in one, by weighted score or by reciprocal rank."""
    v = vector.groupBy("query_id", "uid").agg(F.max("score").alias("v_score"), F.min("rank").alias("v_rank"))
    g = graph.groupBy("query_id", "uid").agg(F.max("score").alias("g_score"), F.min("rank").alias("g_rank"))
    fused = {
        "weighted": f"{alpha}D * coalesce(v_score, 0) + {1 - alpha:.12g}D * coalesce(g_score, 0)",
        "rrf": f"coalesce(1.0D / ({rrf} + v_rank), 0) + coalesce(1.0D / ({rrf} + g_rank), 0)",
    }[method]
    both = v.join(g, ["query_id", "uid"], "full").selectExpr("query_id", "uid", f"{fused} AS score")
    return rank_all(both, ["query_id"], ["score DESC", "uid"], "rank")


def assemble_context(results: DataFrame, n: int = 5, form: str = "plain") -> DataFrame:
    """The first ``n`` results of a query as one prompt text, plain or in tagged blocks."""
    block = {
        "plain": r"concat('[SOURCE: ', uid, ']\n', coalesce(title, ''), '\n', coalesce(content, ''))",
        "tagged": r"concat('\n[SOURCE: ', uid, ']\n[TYPE: ', node_type, ']\n[TITLE: ', title, ']\n[CONTENT:]\n', content, '\n[END SOURCE]\n')",
    }[form]
    sep = {"plain": r"'\n\n'", "tagged": r"'\n'"}[form]
    return (
        results.filter(f"rank <= {int(n)}")
        .selectExpr("query_id", f"struct(rank, {block} AS text) AS b")
        .groupBy("query_id")
        .agg(F.expr(f"array_join(transform(array_sort(collect_list(b)), x -> x.text), {sep})").alias("context"))
    )


def document_requirements(results: DataFrame, documents: DataFrame) -> DataFrame:
    """Results of each document's query that belong to the document, by its id in the chunk id or document id.

    ``documents(query_id, document_id)`` says which document a query asks for.
    """
    asked = documents.selectExpr("query_id", "document_id AS asked_id")
    return results.join(asked, "query_id").filter("contains(uid, asked_id) OR contains(document_id, asked_id)")


def retrieval_audit(context: DataFrame, queries: DataFrame, action: str = "retrieve_grounded_context") -> DataFrame:
    """One audit row per query and chunk of its context."""
    hashed = queries.selectExpr("query_id", f"{ids.query_hash('text')} AS query_hash")
    return context.join(hashed, "query_id").selectExpr(
        "query_id", f"'{action}' AS action", "query_hash", "rank", "uid AS chunk_id", "retrieval_score"
    )
