"""A property graph in two tables: ``nodes(uid, label, ...)`` and ``edges(source_uid, rel_type, target_uid, ...)``.

Intent where the described behaviour contradicts itself: requirement and standard nodes get their uid,
requirements are read from both chunk forms, figure numbers are strings, standards are de-duplicated,
``reference_text`` is stored, and rows sent are counted apart from rows stored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.functions import ids
from clauseloom.functions import text as tx
from clauseloom.operators.structure import whole_clauses
from clauseloom.plans.stage import discard, stage

_CLAUSE = ids.clause_uid("document_id", "clause_id")
#: Where a node stands in its clause, as long as nodes are only sent; the last one of a uid is stored.
SEQ = "_seq"
_TXN = "substring(sha2(concat(document_id, ':', coalesce(document_hash, '')), 256), 1, 16) AS transaction_id"


def uniform_chunks(chunks: DataFrame, hashes: DataFrame | None = None) -> DataFrame:
    """Flat and nested chunks in one shape. ``hashes(document_id, document_hash)`` versions the nodes."""
    has = set(chunks.columns)
    nested = "document_metadata" in has

    def pick(flat: str, deep: str, empty: str) -> str:
        options = ([deep] if nested else []) + ([flat] if flat.split(".")[0] in has else [])
        return f"coalesce({', '.join([*options, empty])})"

    def first_filled(flat: str, deep: str, kind: str) -> str:
        options = ([f"CASE WHEN size({deep}) > 0 THEN {deep} END"] if nested else []) + (
            [flat] if flat.split(".")[0] in has else []
        )
        return f"coalesce({', '.join([*options, f'CAST(array() AS {kind})'])})"

    zero = {c: (c if c in has else f"0L AS {c}") for c in ("part", "tables_before", "figures_before", "requirements_before")}
    out = chunks.selectExpr(
        f"{pick('document_id', 'document_metadata.id', 'CAST(NULL AS STRING)')} AS document_id",
        f"{ids.clause_of_chunk('chunk_id')} AS clause_id",
        "title",
        f"{pick('parent_id', "nullif(hierarchy.parent_id, '')", 'CAST(NULL AS STRING)')} AS parent_id",
        f"{first_filled('children_ids', 'hierarchy.children_ids', 'ARRAY<STRING>')} AS children_ids",
        ("coalesce(hierarchy.level, 0)" if nested else "0") + " AS given_level",
        "content", "tables", "figures",
        first_filled("requirements", "enrichment.requirements", "ARRAY<STRUCT<type: STRING, keyword: STRING, text: STRING>>")
        + " AS requirements",
        first_filled("references.clauses", "enrichment.internal_refs.clauses", "ARRAY<STRING>") + " AS ref_clauses",
        first_filled("references.standards", "enrichment.external_refs", "ARRAY<STRING>") + " AS ref_standards",
        "is_first" if "is_first" in has else "true AS is_first",
        *zero.values(),
    )
    if hashes is None:
        return out.withColumn("document_hash", F.lit(None).cast("string"))
    return out.join(hashes.select("document_id", "document_hash"), "document_id", "left")


def document_nodes(stats: DataFrame) -> DataFrame:
    """One node per document with its counts. ``stats`` may carry ``document_hash``."""
    hashed = stats if "document_hash" in stats.columns else stats.withColumn("document_hash", F.lit(None).cast("string"))
    return hashed.selectExpr(
        f"{ids.document_uid('document_id')} AS uid", "'Document' AS label", "document_id",
        "concat(document_id, '.pdf') AS filename", "total_clauses", "total_tables", "total_images AS total_figures",
        "document_hash", _TXN,
    )


def clause_nodes(chunks: DataFrame) -> DataFrame:
    """One node per clause with the text, children and flags of all its parts; :func:`clause_texts` gives the text
    in bounded rows."""
    return whole_clauses(chunks, ("document_id", "clause_id")).selectExpr(
        f"{_CLAUSE} AS uid", "'Clause' AS label", "document_id", "clause_id", "coalesce(title, '') AS title",
        f"CASE WHEN parent_id <> '' THEN {ids.clause_uid('document_id', 'parent_id')} END AS parent_uid",
        f"transform(children_ids, c -> {ids.clause_uid('document_id', 'c')}) AS children_uids",
        r"CASE WHEN given_level = 0 THEN size(split(clause_id, r'\.')) ELSE given_level END AS level",
        "content_text", "CAST(length(content_text) AS BIGINT) AS content_length", "has_requirements", "has_tables", "has_figures",
        "document_hash", _TXN,
    )


def clause_texts(chunks: DataFrame) -> DataFrame:
    """The whole text of every clause, in bounded parts."""
    return chunks.filter("size(content) > 0").selectExpr(
        f"{_CLAUSE} AS uid", "part", f"{tx.joined_text('content')} AS content_text"
    )


def requirement_nodes(chunks: DataFrame, by: str = "text") -> DataFrame:
    """One node per requirement; ``by`` chooses the id from the text's hash or from the index in the clause."""
    uid = {
        "text": ids.requirement_uid("document_id", "clause_id", "r.text"),
        "index": ids.requirement_uid_by_index("document_id", "clause_id", "idx + requirements_before"),
    }[by]
    return chunks.selectExpr("*", "posexplode(requirements) AS (idx, r)").selectExpr(
        f"{uid} AS uid", "'Requirement' AS label", "document_id", "clause_id", "r.type AS requirement_type",
        "r.keyword AS keyword", "r.text AS text", f"{_CLAUSE} AS source_clause_uid", "document_hash", _TXN,
    )


def table_nodes(chunks: DataFrame, sent: bool = False) -> DataFrame:
    """One node per table. The width is that of the first row; a table without number takes its index. ``sent`` adds
    its place in the clause."""
    return (
        chunks.selectExpr("*", "posexplode(tables) AS (idx, t)")
        .selectExpr("*", "coalesce(t.number, CAST(idx + 1 + tables_before AS STRING)) AS table_number")
        .selectExpr(
            f"{ids.table_uid('document_id', 'clause_id', 'table_number')} AS uid", "'Table' AS label", "document_id",
            "clause_id", "table_number", "t.caption AS caption", "coalesce(size(t.rows), 0) AS row_count",
            "coalesce(size(try_element_at(t.rows, 1)), 0) AS column_count", f"{_CLAUSE} AS source_clause_uid",
            "document_hash", _TXN, *([f"CAST(idx + tables_before AS BIGINT) AS {SEQ}"] if sent else []),
        )
    )


def figure_nodes(chunks: DataFrame, sent: bool = False) -> DataFrame:
    """One node per figure; ``sent`` adds its place in the clause."""
    return (
        chunks.selectExpr("*", "posexplode(figures) AS (idx, f)")
        .selectExpr("*", "coalesce(f.number, CAST(idx + 1 + figures_before AS STRING)) AS figure_number")
        .selectExpr(
            f"{ids.figure_uid('document_id', 'clause_id', 'figure_number')} AS uid", "'Figure' AS label", "document_id",
            "clause_id", "figure_number", "f.caption AS caption", "f.path AS image_path",
            f"{_CLAUSE} AS source_clause_uid", "document_hash", _TXN,
            *([f"CAST(idx + figures_before AS BIGINT) AS {SEQ}"] if sent else []),
        )
    )


def _standard_mentions(chunks: DataFrame) -> DataFrame:
    return chunks.selectExpr("document_id", "clause_id", "document_hash", "explode(ref_standards) AS standard_name")


def standard_nodes(chunks: DataFrame) -> DataFrame:
    """One node per external standard, whatever its spelling; the smallest spelling names it."""
    return (
        _standard_mentions(chunks)
        .selectExpr(f"{ids.standard_uid('standard_name')} AS uid", "standard_name")
        .groupBy("uid")
        .agg(F.min("standard_name").alias("standard_name"))
        .selectExpr("uid", "'Standard' AS label", "standard_name", f"{ids.normalized_standard('standard_name')} AS normalized_name")
    )


def _edge(df: DataFrame, source: str, rel: str, target: str, ref: str = "CAST(NULL AS STRING)") -> DataFrame:
    return df.selectExpr(
        f"{source} AS source_uid", f"'{rel}' AS rel_type", f"{target} AS target_uid", f"{ref} AS reference_text",
        "document_id", _TXN if "transaction_id" not in df.columns else "transaction_id",
    )


def contains_edges(chunks: DataFrame) -> DataFrame:
    """Parent clause, or the document where there is none, to clause."""
    parent = (
        f"CASE WHEN parent_id <> '' THEN {ids.clause_uid('document_id', 'parent_id')}"
        f" ELSE {ids.document_uid('document_id')} END"
    )
    return _edge(chunks.filter("is_first"), parent, "CONTAINS", _CLAUSE)


def requires_edges(requirements: DataFrame, rel_type: str = "REQUIRES") -> DataFrame:
    return _edge(requirements, "source_clause_uid", rel_type, "uid")


def content_edges(tables: DataFrame, figures: DataFrame) -> DataFrame:
    return _edge(tables, "source_clause_uid", "HAS_TABLE", "uid").unionByName(
        _edge(figures, "source_clause_uid", "HAS_FIGURE", "uid")
    )


def reference_edges(chunks: DataFrame, present_only: bool = True) -> DataFrame:
    """REFERS_TO a clause of the same document, by default only one among ``chunks``; REFERENCES to a standard always."""
    inner = _edge(
        chunks.selectExpr("document_id", "clause_id", "document_hash", "explode(ref_clauses) AS ref"),
        _CLAUSE, "REFERS_TO", ids.clause_uid("document_id", "ref"), "concat('Clause ', ref)",
    )
    if present_only:
        inner = inner.join(chunks.filter("is_first").selectExpr(f"{_CLAUSE} AS target_uid"), "target_uid", "left_semi")
    outer = _edge(_standard_mentions(chunks), _CLAUSE, "REFERENCES", ids.standard_uid("standard_name"), "standard_name")
    return inner.unionByName(outer)


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def sent_nodes(chunks: DataFrame, stats: DataFrame) -> DataFrame:
    """All nodes a batch of uniform chunks sends, repeats included except for standards."""
    return _union(
        [
            document_nodes(stats), clause_nodes(chunks), requirement_nodes(chunks), table_nodes(chunks, sent=True),
            figure_nodes(chunks, sent=True), standard_nodes(chunks),
        ]
    )


def sent_edges(chunks: DataFrame, present_only: bool = True) -> DataFrame:
    """All edges a batch sends, also those whose end may be missing; references to clauses as in :func:`reference_edges`."""
    return _union(
        [
            contains_edges(chunks), requires_edges(requirement_nodes(chunks)),
            content_edges(table_nodes(chunks), figure_nodes(chunks)), reference_edges(chunks, present_only),
        ]
    )


def merge_nodes(existing: DataFrame | None, incoming: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Upsert by (label, uid). A field the incoming rows have is overwritten, also by null; one they lack stays.

    Among repeats in the batch the last by ``order`` wins, of :func:`sent_nodes` the last in the clause, and of equal ones
    the largest row, through a max that combines on the map side.
    """
    keys = ["label", "uid"]
    fields = [c for c in incoming.columns if c not in (*keys, SEQ)]
    row = f"struct({', '.join(fields)})"
    order = order or [c for c in (SEQ,) if c in incoming.columns]
    # The row is in what is compared, so that it is not shuffled a second time beside it.
    pick = f"max(struct({', '.join([*order, row + ' AS _row'])}))._row" if order else f"max({row})"
    last = incoming.groupBy(*keys).agg(F.expr(pick).alias("_new"))
    if existing is None:
        return last.select(*keys, "_new.*")
    both = existing.join(last, keys, "full")
    every = [c for c in existing.columns if c not in keys] + [f for f in fields if f not in existing.columns]
    def value(c: str) -> str:
        if c not in fields:
            return c
        old = c if c in existing.columns else "NULL"
        return f"CASE WHEN _new IS NOT NULL THEN _new.{c} ELSE {old} END AS {c}"
    return both.selectExpr(*keys, *[value(c) for c in every])


_EDGE_KEYS = ["source_uid", "rel_type", "target_uid"]


def _last_edges(incoming: DataFrame) -> tuple[DataFrame, list[str]]:
    fields = [c for c in incoming.columns if c not in _EDGE_KEYS]
    return incoming.groupBy(*_EDGE_KEYS).agg(F.expr(f"max(struct({', '.join(fields)}))").alias("_new")), fields


def upsert_edges(existing: DataFrame | None, last: DataFrame, fields: list[str]) -> DataFrame:
    if existing is None:
        return last.select(*_EDGE_KEYS, "_new.*")
    both = existing.join(last, _EDGE_KEYS, "full")
    return both.selectExpr(*_EDGE_KEYS, *[f"CASE WHEN _new IS NOT NULL THEN _new.{c} ELSE {c} END AS {c}" for c in fields])


def closed_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges whose both ends exist."""
    uids = nodes.select("uid").distinct()
    return edges.join(uids, F.expr("source_uid = uid"), "left_semi").join(uids, F.expr("target_uid = uid"), "left_semi")


def merge_sent_edges(existing: DataFrame | None, incoming: DataFrame) -> DataFrame:
    """One edge per (source, type, target), whether or not its ends are there yet."""
    return upsert_edges(existing, *_last_edges(incoming))


def merge_edges(existing: DataFrame | None, incoming: DataFrame, nodes: DataFrame) -> DataFrame:
    """One edge per (source, type, target), stored only when both ends exist."""
    last, fields = _last_edges(incoming)
    return upsert_edges(existing, closed_edges(last, nodes), fields)


def build_graph(
    chunks: DataFrame, stats: DataFrame, nodes: DataFrame | None = None, edges: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Uniform chunks and document statistics merged into a graph: nodes first, then the edges between them."""
    new_nodes = merge_nodes(nodes, sent_nodes(chunks, stats))
    return new_nodes, merge_edges(edges, sent_edges(chunks), new_nodes)


def existing_uids(nodes: DataFrame) -> DataFrame:
    return nodes.filter("uid IS NOT NULL").select("uid").distinct()


def nodes_exist(uids: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each asked uid with ``found``."""
    known = existing_uids(nodes).withColumn("found", F.lit(True))
    return uids.join(known, "uid", "left").withColumn("found", F.expr("coalesce(found, false)"))


def delete_document(nodes: DataFrame, edges: DataFrame, document_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without the nodes of some documents and the edges that touch them. Standards stay."""
    ids_ = document_ids.select("document_id").distinct()
    gone = nodes.join(ids_, "document_id", "left_semi").select("uid").distinct()
    left = edges.join(gone, F.expr("source_uid = uid"), "left_anti").join(gone, F.expr("target_uid = uid"), "left_anti")
    return nodes.join(ids_, "document_id", "left_anti"), left


def graph_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    by_label = nodes.groupBy("label").agg(F.count("*").alias("n"))
    total = edges.agg(F.count("*").alias("n")).selectExpr("'relationships' AS label", "n")
    return by_label.unionByName(total)


def graph_transactions(
    sent_n: DataFrame, sent_e: DataFrame, stored_e: DataFrame, gate: DataFrame, stored_n: DataFrame | None = None
) -> DataFrame:
    """Per document one transaction: its id, what was sent and stored, and whether the gate let it in. ``gate`` may carry the
    document's hash; without ``stored_n`` the nodes stored are the distinct ones sent."""
    def per_document(df: DataFrame, name: str) -> DataFrame:
        return df.filter("document_id IS NOT NULL").groupBy("document_id").agg(F.count("*").alias(name))

    stored_n = sent_n.select("document_id", "label", "uid").distinct() if stored_n is None else stored_n
    counted = (
        gate.join(per_document(sent_n, "nodes_sent"), "document_id", "left")
        .join(per_document(stored_n, "nodes_stored"), "document_id", "left")
        .join(per_document(sent_e, "edges_sent"), "document_id", "left")
        .join(per_document(stored_e, "edges_stored"), "document_id", "left")
    )
    if "document_hash" not in gate.columns:
        counted = counted.withColumn("document_hash", F.lit(None).cast("string"))
    counts = ("nodes_sent", "nodes_stored", "edges_sent", "edges_stored")
    return counted.selectExpr(
        _TXN, "document_id", "document_hash",
        "CASE WHEN accepted THEN 'completed' ELSE 'failed' END AS status",
        "error_message",
        *[f"CASE WHEN accepted THEN coalesce({c}, 0) ELSE 0 END AS {c}" for c in counts],
    )


def _doubled(jumps: DataFrame, more: str = "true", also: tuple[str, ...] = ()) -> DataFrame:
    """Jumps ``(uid, top, ended)`` from each node upwards, made to end at nodes without a parent.

    Every round a jump that has not ended takes the jumps of the node it came to, so its length doubles: a hierarchy of any
    depth takes its logarithm in rounds. What has not ended when jumps are longer than there are nodes goes round a cycle
    and is dropped. ``also`` are further expressions over both jumps a and b, and ``more`` a condition a joined jump must meet.
    """
    jumps = stage(jumps, "jumps")
    rounds = max(1, jumps.select("uid").distinct().count()).bit_length() + 1
    done = [jumps.filter("ended")]
    while rounds and not jumps.filter("NOT ended").isEmpty():
        longer = jumps.filter("NOT ended").alias("a").join(jumps.alias("b"), F.expr("a.top = b.uid")).filter(more)
        longer = longer.selectExpr("a.uid AS uid", "b.top AS top", "b.ended AS ended", *also).distinct()
        # Those that have ended are needed by others as well.
        before, jumps = jumps, stage(longer.unionByName(jumps.filter("ended")).distinct(), "jumps")
        discard(before)
        done, rounds = [jumps.filter("ended")], rounds - 1
    return done[0]


def _parents(edges: DataFrame) -> DataFrame:
    """Jumps over one CONTAINS edge; one to a node that nothing contains has ended."""
    up = stage(edges.filter("rel_type = 'CONTAINS'").selectExpr("target_uid AS uid", "source_uid AS top").distinct(), "contains")
    inner = up.selectExpr("uid AS _inner").distinct()
    return up.join(inner, F.expr("top = _inner"), "left").selectExpr("uid", "top", "_inner IS NULL AS ended")


def clause_ancestors(edges: DataFrame) -> DataFrame:
    """``uid, root, depth, path``: the way from the root down to each contained node, one row per way.

    A root is a document, or a clause whose own parent is not there. A cycle has none."""
    first = _parents(edges).withColumn("path", F.array("top"))
    ways = _doubled(first, "size(array_distinct(concat(a.path, b.path))) = size(a.path) + size(b.path)", ("concat(a.path, b.path) AS path",))
    return ways.selectExpr("uid", "top AS root", "size(path) AS depth", "reverse(path) AS path")


def clause_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Clauses each document reaches over CONTAINS, zero kept, at any depth and also with a cycle, in as many rounds as the
    depth has binary digits. Every round is written to the shared folder, so a lost executor costs no recomputation."""
    reached = _doubled(_parents(edges))
    is_clause = nodes.filter("label = 'Clause'").select("uid").distinct()
    counts = reached.join(is_clause, "uid", "left_semi").groupBy("top").agg(F.count("*").alias("n"))
    documents = nodes.filter("label = 'Document'").selectExpr("document_id", "uid AS top")
    return documents.join(counts, "top", "left").selectExpr("document_id", "coalesce(n, 0) AS clause_count")


def list_graph_documents(nodes: DataFrame) -> DataFrame:
    return nodes.filter("label = 'Document'").select("document_id", "total_clauses")
