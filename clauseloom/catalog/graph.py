"""Queries over quality rules and the property graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauseloom.catalog import fixtures as fx
from clauseloom.catalog.structure import long_chunks, one_document
from clauseloom.functions import ids
from clauseloom.operators import graph as gr
from clauseloom.operators import quality as ql
from clauseloom.operators import structure as st
from clauseloom.plans.stage import settled, stage


def chunks(spark, sf):
    """The chunk table, written once because everything below reads it several times."""
    return settled(lambda: [_chunks(fx.document_blocks(spark, sf))], "chunks")[0]


def _chunks(blocks):
    return st.chunk_references(st.make_chunks(blocks))


def _stats(blocks):
    return st.document_statistics(st.assign_blocks(blocks))


def chunks_and_stats(spark, sf):
    """Chunks and document statistics, both from one block table."""
    def make():
        blocks = fx.document_blocks(spark, sf)
        return _chunks(blocks), _stats(blocks)

    return settled(make, "batch")


def uniform(spark, sf):
    return gr.uniform_chunks(chunks(spark, sf))


def stats(spark, sf):
    return st.document_statistics(st.assign_blocks(fx.document_blocks(spark, sf)))


def list_graph_documents(spark, sf):
    """Of texts that may end in a number alone, which opens no clause."""
    counts = _stats(fx.document_blocks(spark, sf, numbers_end=True))
    return gr.list_graph_documents(gr.document_nodes(counts))


def batch(spark, sf):
    """Uniform chunks and document statistics."""
    rows, counts = chunks_and_stats(spark, sf)
    return gr.uniform_chunks(rows), counts


def graph(spark, sf):
    return gr.build_graph(*batch(spark, sf))


def stored_graph(spark, sf):
    """Nodes and edges, written."""
    return settled(lambda: graph(spark, sf), "graph")


def nested_chunks(spark, sf):
    return _nested(chunks(spark, sf))


def _nested(chunks):
    """The nested chunk form: one third flat, one third with types the gate knows, one third as extracted."""
    known = "CASE c.type WHEN 'list_item' THEN 'list' WHEN 'paragraph' THEN 'paragraph' ELSE 'paragraph' END"
    return (
        chunks
        .selectExpr("*", "CAST(substring(document_id, 4) AS BIGINT) % 3 AS form")
        .selectExpr(
            "chunk_id",
            "CASE WHEN form = 0 THEN document_id END AS document_id",
            "CASE WHEN form <> 0 THEN named_struct('id', document_id) END AS document_metadata",
            "title", "parent_id",
            r"named_struct('parent_id', parent_id, 'children_ids', children_ids, 'level', size(split(chunk_id, r'\.'))) AS hierarchy",
            f"CASE WHEN form = 1 THEN transform(content, c -> struct({known} AS type, c.text AS text)) ELSE content END AS content",
            "tables", "figures", "requirements", "children_ids",
            "named_struct('requirements', requirements, 'internal_refs', named_struct('clauses', references.clauses),"
            " 'external_refs', references.standards) AS enrichment",
        )
    )


_DOC = "coalesce(document_metadata.id, document_id) AS document_id"


def _flag(check, name):
    def run(spark, sf):
        return check(nested_chunks(spark, sf)).selectExpr(_DOC, "chunk_id", name)

    return run


def validation_gate(spark, sf):
    return ql.validation_gate(nested_chunks(spark, sf)).selectExpr(_DOC, "chunk_id", "error")


def flat_format_bypass(spark, sf):
    strict = ql.validation_gate(nested_chunks(spark, sf), flat_passes=False)
    return strict.selectExpr(_DOC, "chunk_id", "error")


def document_gate(spark, sf):
    return ql.document_gate(ql.validation_gate(nested_chunks(spark, sf)))


def field_rules(spark, sf):
    docs = fx.read(spark, sf, "documents").selectExpr(
        "doc_id AS id", "CASE WHEN doc_id % 4 = 0 THEN md5(text) ELSE sha2(text, 256) END AS hash",
        "CASE WHEN doc_id % 5 = 0 THEN 'LOST' ELSE 'PENDING' END AS status", "concat(source, '.txt') AS filename",
    )
    blocks = fx.document_blocks(spark, sf)
    clauses = st.clause_dim(st.open_clauses(st.assign_blocks(st.headers_only(blocks))))
    tagged = clauses.selectExpr(
        "CASE WHEN first_pos % 3 = 0 THEN concat(document_id, ':', clause_id) ELSE clause_id END AS chunk_id",
        r"size(split(clause_id, r'\.')) * 4 AS level",
    )
    both = ql.document_rules(docs).unionByName(ql.clause_rules(clauses.withColumn("document_id", F.expr("substring(document_id, 4)"))))
    return both.unionByName(ql.chunk_rules(tagged)).groupBy("rule").agg(F.count("*").alias("n"), F.min("key").alias("first_key"))


def unique_uids(spark, sf):
    u = uniform(spark, sf)
    return ql.unique_uids(gr.requirement_nodes(u).select("label", "uid").unionByName(gr.table_nodes(u).select("label", "uid")))


def fk_violations(spark, sf):
    content = st.content_blocks(st.assign_blocks(fx.document_blocks(spark, sf)))
    clauses = st.open_clauses(st.assign_blocks(st.headers_only(fx.document_blocks(spark, sf))))
    rows = content.selectExpr("document_id", "pos", "concat(document_id, ':', CASE WHEN pos % 4 = 0 THEN 'gone' ELSE clause_id END) AS chunk_id")
    return ql.fk_violations(rows, clauses.selectExpr("concat(document_id, ':', clause_id) AS id"), "chunk_id", "id")


def uid_columns(spark, sf):
    names = fx.read(spark, sf, "part").selectExpr("p_partkey", "p_name", "p_brand", "p_type")
    return names.selectExpr(
        "p_partkey", f"{ids.document_uid('p_brand')} AS document_uid", f"{ids.clause_uid('p_brand', 'p_type')} AS clause_uid",
        f"{ids.requirement_uid('p_brand', 'p_type', 'p_name')} AS requirement_uid",
        f"{ids.table_uid('p_brand', 'p_type', 'p_partkey')} AS table_uid",
        f"{ids.standard_uid('concat(p_brand, chr(47), p_type)')} AS standard_uid",
        f"{ids.normalized_standard('concat(p_brand, chr(47), p_type)')} AS normalized_name",
        f"{ids.clause_of_chunk(ids.chunk_id('p_brand', 'p_type'))} AS clause_id",
    )


def long_uniform(spark, sf):
    return gr.uniform_chunks(st.chunk_references(long_chunks(spark, sf)))


def _clause_nodes(chunks):
    return gr.clause_nodes(chunks).selectExpr(
        "uid", "title", "parent_uid", "array_join(children_uids, '|') AS children_uids", "level", "content_length",
        "md5(content_text) AS text_hash", "has_requirements", "has_tables", "has_figures",
    )


def requirement_nodes(spark, sf):
    u = uniform(spark, sf)
    cols = ("uid", "requirement_type", "keyword", "source_clause_uid")
    return gr.requirement_nodes(u).select(*cols).unionByName(gr.requirement_nodes(u, by="index").select(*cols))


def _edges(make):
    def run(spark, sf):
        return make(uniform(spark, sf)).select("source_uid", "rel_type", "target_uid", "reference_text")

    return run


def existing_uids(spark, sf):
    u = uniform(spark, sf)
    nodes = gr.clause_nodes(u).select("uid")
    asked = gr.contains_edges(u).selectExpr("source_uid AS uid").distinct()
    return gr.nodes_exist(asked, nodes)


def merge_nodes(spark, sf):
    """Customers as existing nodes; a later batch from orders overwrites some fields and adds others."""
    old = fx.read(spark, sf, "customer").selectExpr(
        "concat('c', c_custkey) AS uid", "'Customer' AS label", "c_name AS name", "c_mktsegment AS segment", "c_acctbal AS balance")
    new = fx.read(spark, sf, "orders").selectExpr(
        "concat('c', o_custkey * 2) AS uid", "'Customer' AS label",
        "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS segment", "o_orderkey AS seq", "o_orderstatus AS status")
    return gr.merge_nodes(old, new, ["seq"]).drop("seq")


def merge_edges(spark, sf):
    nodes, edges = graph(spark, sf)
    return edges.select("source_uid", "rel_type", "target_uid")


def build_graph(spark, sf):
    """The same batch twice: the second merge changes nothing."""
    rows, counts = batch(spark, sf)
    nodes, edges = gr.build_graph(rows, counts)
    again, edges_again = gr.build_graph(rows, counts, stage(nodes, "nodes"), stage(edges, "edges"))
    out = again.groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("uid").alias("uids"))
    return out.unionByName(edges_again.groupBy(F.col("rel_type").alias("label")).agg(
        F.count("*").alias("n"), F.count_distinct("target_uid").alias("uids")))


def delete_document(spark, sf):
    nodes, edges = stored_graph(spark, sf)
    toxic = fx.read(spark, sf, "labels").filter("toxic = 1").selectExpr("concat('doc', doc_id) AS document_id")
    n, e = gr.delete_document(nodes, edges, toxic)
    return gr.graph_statistics(n, e)


def graph_statistics(spark, sf):
    return gr.graph_statistics(*graph(spark, sf))


def graph_transactions(spark, sf):
    rows, counts = chunks_and_stats(spark, sf)
    u = gr.uniform_chunks(rows)
    sent = gr.sent_nodes(u, counts)
    nodes = gr.merge_nodes(None, sent)
    edges = gr.sent_edges(u)
    gate = ql.document_gate(ql.validation_gate(_nested(rows)))
    return gr.graph_transactions(sent, edges, gr.merge_edges(None, edges, nodes), gate)


def clause_counts(spark, sf):
    nodes, edges = stored_graph(spark, sf)
    return gr.clause_counts(nodes, edges)


def clause_ancestors(spark, sf):
    _, edges = graph(spark, sf)
    return gr.clause_ancestors(edges).selectExpr("uid", "root", "depth", "array_join(path, ' > ') AS path")


QUERIES = {
    "clause_ancestors": clause_ancestors,
    "check_structural": _flag(ql.check_structural, "structural_ok"),
    "check_referential": _flag(ql.check_referential, "parent_ok"),
    "check_enums": _flag(ql.check_enums, "enums_ok"),
    "validation_gate": validation_gate,
    "flat_format_bypass": flat_format_bypass,
    "document_gate": document_gate,
    "field_rules": field_rules,
    "unique_uids": unique_uids,
    "fk_violations": fk_violations,
    "uid_columns": uid_columns,
    "document_nodes": lambda s, d: gr.document_nodes(stats(s, d)),
    "clause_nodes": lambda s, d: _clause_nodes(uniform(s, d)),
    "clause_nodes_long": lambda s, d: _clause_nodes(long_uniform(s, d)),
    "requirement_nodes": requirement_nodes,
    "table_nodes": lambda s, d: gr.table_nodes(uniform(s, d)).drop("document_hash", "transaction_id"),
    "figure_nodes": lambda s, d: gr.figure_nodes(uniform(s, d)).drop("document_hash", "transaction_id"),
    "standard_nodes": lambda s, d: gr.standard_nodes(uniform(s, d)),
    "contains_edges": _edges(gr.contains_edges),
    "requires_edges": _edges(lambda u: gr.requires_edges(gr.requirement_nodes(u))),
    "content_edges": _edges(lambda u: gr.content_edges(gr.table_nodes(u), gr.figure_nodes(u))),
    "reference_edges": _edges(gr.reference_edges),
    "merge_nodes": merge_nodes,
    "merge_edges": merge_edges,
    "existing_uids": existing_uids,
    "delete_document": delete_document,
    "graph_statistics": graph_statistics,
    "graph_transactions": graph_transactions,
    "clause_counts": clause_counts,
    "list_graph_documents": list_graph_documents,
    "build_graph": build_graph,
}

_CL = "'clause:' || document_id || ':' || clause_id"
_REF = "(?:^|[^\\p{L}\\p{N}_])"

#: CTEs for the graph: everything sent, then what is stored.
SQL_GRAPH = (
    fx.SQL_PARTS
    + f""",
req_n AS (SELECT *, row_number() OVER (PARTITION BY document_id, clause_id ORDER BY pos) - 1 AS idx,
   'requirement:' || document_id || ':' || clause_id || ':' || md5(text)[1:8] AS uid FROM reqs),
tab_n AS (SELECT *, 'table:' || document_id || ':' || clause_id || ':' || table_number AS uid FROM (SELECT *,
   coalesce(number, CAST(row_number() OVER (PARTITION BY document_id, clause_id ORDER BY pos) AS VARCHAR)) AS table_number FROM tabs)),
fig_n AS (SELECT *, 'figure:' || document_id || ':' || clause_id || ':' || number AS uid FROM figs),
ref_c AS (SELECT DISTINCT document_id, clause_id, unnest(regexp_extract_all(text, '(?i){_REF}clause\\s+([A-Z]?\\d+(?:\\.\\d+)*)', 1)) AS ref FROM content),
ref_s AS (SELECT DISTINCT document_id, clause_id, unnest(regexp_extract_all(text, '{_REF}((?:ISO/IEC|IEC|ISO|CISPR|EN)\\s+\\d+(?:-\\d+)*)', 1)) AS std FROM content),
std AS (SELECT *, 'standard:' || replace(upper(regexp_replace(std, '[ -]', '', 'g')), '/', '_') AS uid FROM ref_s),
e_contains AS (SELECT coalesce('clause:' || document_id || ':' || parent_id, 'document:' || document_id) AS source_uid,
   'CONTAINS' AS rel_type, {_CL} AS target_uid, CAST(NULL AS VARCHAR) AS reference_text, document_id FROM levels),
e_req AS (SELECT {_CL} AS source_uid, 'REQUIRES' AS rel_type, uid AS target_uid, CAST(NULL AS VARCHAR) AS reference_text, document_id FROM req_n),
e_content AS (SELECT {_CL} AS source_uid, 'HAS_TABLE' AS rel_type, uid AS target_uid, CAST(NULL AS VARCHAR) AS reference_text, document_id FROM tab_n
   UNION ALL SELECT {_CL}, 'HAS_FIGURE', uid, NULL, document_id FROM fig_n),
e_ref AS (SELECT {_CL} AS source_uid, 'REFERS_TO' AS rel_type, 'clause:' || document_id || ':' || ref AS target_uid, 'Clause ' || ref AS reference_text, document_id
   FROM ref_c WHERE (document_id, ref) IN (SELECT document_id, clause_id FROM clauses)
   UNION ALL SELECT {_CL}, 'REFERENCES', uid, std, document_id FROM std),
sent_e AS (SELECT * FROM e_contains UNION ALL SELECT * FROM e_req UNION ALL SELECT * FROM e_content UNION ALL SELECT * FROM e_ref),
sent_n AS (SELECT 'Document' AS label, 'document:' || document_id AS uid, document_id FROM stats
   UNION ALL SELECT 'Clause', {_CL}, document_id FROM clauses UNION ALL SELECT 'Requirement', uid, document_id FROM req_n
   UNION ALL SELECT 'Table', uid, document_id FROM tab_n UNION ALL SELECT 'Figure', uid, document_id FROM fig_n
   UNION ALL SELECT DISTINCT 'Standard', uid, CAST(NULL AS VARCHAR) FROM std),
nodes AS (SELECT DISTINCT label, uid, document_id FROM sent_n),
edges AS (SELECT DISTINCT source_uid, rel_type, target_uid FROM sent_e
   WHERE source_uid IN (SELECT uid FROM nodes) AND target_uid IN (SELECT uid FROM nodes)),
forms AS (SELECT c.document_id, c.clause_id AS chunk_id, CAST(substring(c.document_id, 4) AS BIGINT) % 3 AS form, l.parent_id,
   EXISTS (SELECT 1 FROM content x WHERE x.document_id = c.document_id AND x.clause_id = c.clause_id)
   OR EXISTS (SELECT 1 FROM tabs x WHERE x.document_id = c.document_id AND x.clause_id = c.clause_id)
   OR EXISTS (SELECT 1 FROM figs x WHERE x.document_id = c.document_id AND x.clause_id = c.clause_id) AS filled,
   EXISTS (SELECT 1 FROM content x WHERE x.document_id = c.document_id AND x.clause_id = c.clause_id AND type <> 'paragraph') AS odd_type,
   l.parent_id IS NULL OR EXISTS (SELECT 1 FROM clauses p WHERE p.document_id = c.document_id AND p.clause_id = l.parent_id) AS parent_ok
   FROM clauses c JOIN levels l USING (document_id, clause_id)),
strict AS (SELECT *, CASE WHEN form = 0 OR NOT filled THEN '{ql.STAGE_ERRORS["1"]}' WHEN NOT parent_ok THEN '{ql.STAGE_ERRORS["2"]}'
   WHEN form <> 1 AND odd_type THEN '{ql.STAGE_ERRORS["3"]}' END AS strict_error FROM forms),
gate AS (SELECT document_id, count(*) FILTER (error IS NULL) AS passed, count(*) FILTER (error IS NOT NULL) AS failed
   FROM (SELECT *, CASE WHEN form <> 0 THEN strict_error END AS error FROM strict) GROUP BY document_id)"""
)


def _g(select):
    return fx.with_ctes(SQL_GRAPH, select)


_EDGE = "SELECT source_uid, rel_type, target_uid, reference_text FROM "
_STATS = """SELECT label, count(*) AS n FROM {n} GROUP BY label UNION ALL SELECT 'relationships', count(*) FROM {e}"""

_SQL_CLAUSES = f"""SELECT {_CL} AS uid, title, 'clause:' || document_id || ':' || parent_id AS parent_uid,
        coalesce((SELECT string_agg('clause:' || t.document_id || ':' || t.clause_id, '|' ORDER BY first_pos) FROM tree t
          WHERE t.document_id = l.document_id AND t.tree_parent_id = l.clause_id), '') AS children_uids, level,
        length(content_text) AS content_length, md5(content_text) AS text_hash,
        EXISTS (SELECT 1 FROM reqs r WHERE r.document_id = l.document_id AND r.clause_id = l.clause_id) AS has_requirements,
        EXISTS (SELECT 1 FROM tabs r WHERE r.document_id = l.document_id AND r.clause_id = l.clause_id) AS has_tables,
        EXISTS (SELECT 1 FROM figs r WHERE r.document_id = l.document_id AND r.clause_id = l.clause_id) AS has_figures FROM levels l"""
#: The same CTEs over all documents as one.
SQL_ONE_GRAPH = "WITH " + one_document(SQL_GRAPH).strip() + "\n"

SQL = {
    "clause_ancestors": "WITH RECURSIVE " + SQL_GRAPH.strip() + """,
        up AS (SELECT source_uid, target_uid FROM edges WHERE rel_type = 'CONTAINS'),
        walk AS (SELECT DISTINCT source_uid AS uid, source_uid AS root, 0 AS depth, CAST(NULL AS VARCHAR) AS path FROM up
            WHERE source_uid NOT IN (SELECT target_uid FROM up)
          UNION ALL SELECT e.target_uid, w.root, w.depth + 1, coalesce(w.path || ' > ', '') || w.uid FROM walk w
          JOIN up e ON e.source_uid = w.uid)
        SELECT * FROM walk WHERE depth > 0""",
    "check_structural": _g("SELECT document_id, chunk_id, form <> 0 AND filled AS structural_ok FROM forms"),
    "check_referential": _g("SELECT document_id, chunk_id, parent_ok FROM forms"),
    "check_enums": _g("SELECT document_id, chunk_id, form = 1 OR NOT odd_type AS enums_ok FROM forms"),
    "validation_gate": _g("SELECT document_id, chunk_id, CASE WHEN form <> 0 THEN strict_error END AS error FROM strict"),
    "flat_format_bypass": _g("SELECT document_id, chunk_id, strict_error AS error FROM strict"),
    "document_gate": _g("""SELECT *, failed = 0 AS accepted,
        CASE WHEN failed > 0 THEN 'Validation failed: ' || failed || ' chunks invalid' END AS error_message FROM gate"""),
    "field_rules": _g("""SELECT rule, count(*) AS n, min(key) AS first_key FROM (
        SELECT 'hash_length' AS rule, CAST(doc_id AS VARCHAR) AS key FROM documents WHERE doc_id % 4 = 0
        UNION ALL SELECT 'status_known', CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id % 5 = 0
        UNION ALL SELECT 'document_id_length', document_id[4:] || ':' || clause_id FROM clauses WHERE length(document_id) < 6
        UNION ALL SELECT 'clause_id_pattern', document_id[4:] || ':' || clause_id FROM clauses WHERE NOT regexp_matches(clause_id, '(?i)^([A-Z]|\\d+)(?:\\.(\\d+))*$')
        UNION ALL SELECT 'chunk_id_has_colon', clause_id FROM clauses WHERE first_pos % 3 <> 0
        UNION ALL SELECT 'level_range', CASE WHEN first_pos % 3 = 0 THEN document_id || ':' || clause_id ELSE clause_id END
          FROM clauses WHERE len(string_split(clause_id, '.')) * 4 > 10) GROUP BY rule"""),
    "unique_uids": _g("""SELECT label, uid, count(*) AS n FROM sent_n WHERE label IN ('Requirement', 'Table')
        GROUP BY ALL HAVING count(*) > 1"""),
    "fk_violations": _g("SELECT document_id, pos, document_id || ':gone' AS chunk_id FROM content WHERE pos % 4 = 0"),
    "uid_columns": """SELECT p_partkey, 'document:' || p_brand AS document_uid, 'clause:' || p_brand || ':' || p_type AS clause_uid,
        'requirement:' || p_brand || ':' || p_type || ':' || md5(p_name)[1:8] AS requirement_uid,
        'table:' || p_brand || ':' || p_type || ':' || p_partkey AS table_uid,
        'standard:' || replace(regexp_replace(upper(p_brand || '/' || p_type), '[ -]', '', 'g'), '/', '_') AS standard_uid,
        regexp_replace(upper(p_brand || '/' || p_type), '[ -]', '', 'g') AS normalized_name, p_type AS clause_id FROM part""",
    "document_nodes": _g("""SELECT 'document:' || document_id AS uid, 'Document' AS label, document_id, document_id || '.pdf' AS filename,
        total_clauses, total_tables, total_images AS total_figures, CAST(NULL AS VARCHAR) AS document_hash,
        sha256(document_id || ':')[1:16] AS transaction_id FROM stats"""),
    "clause_nodes": _g(_SQL_CLAUSES),
    "clause_nodes_long": SQL_ONE_GRAPH + _SQL_CLAUSES,
    "requirement_nodes": _g(f"""SELECT uid, type AS requirement_type, keyword, {_CL} AS source_clause_uid FROM req_n
        UNION ALL SELECT 'requirement:' || document_id || ':' || clause_id || ':' || idx, type, keyword, {_CL} FROM req_n"""),
    "table_nodes": _g(f"""SELECT uid, 'Table' AS label, document_id, clause_id, table_number, caption, 2 AS row_count,
        2 AS column_count, {_CL} AS source_clause_uid FROM tab_n"""),
    "figure_nodes": _g(f"""SELECT uid, 'Figure' AS label, document_id, clause_id, number AS figure_number, caption,
        path AS image_path, {_CL} AS source_clause_uid FROM fig_n"""),
    "standard_nodes": _g("""SELECT uid, 'Standard' AS label, min(std) AS standard_name,
        min(upper(regexp_replace(std, '[ -]', '', 'g'))) AS normalized_name FROM std GROUP BY uid"""),
    "contains_edges": _g(_EDGE + "e_contains"),
    "requires_edges": _g(_EDGE + "e_req"),
    "content_edges": _g(_EDGE + "e_content"),
    "reference_edges": _g(_EDGE + "e_ref"),
    "merge_nodes": """WITH new AS (SELECT 'c' || (o_custkey * 2) AS uid,
          arg_max(CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END, o_orderkey) AS segment,
          arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1)
        SELECT 'Customer' AS label, coalesce('c' || c_custkey, new.uid) AS uid, c_name AS name,
          CASE WHEN new.uid IS NOT NULL THEN nullif(new.segment, '') ELSE c_mktsegment END AS segment, c_acctbal AS balance,
          new.status FROM customer FULL JOIN new ON 'c' || c_custkey = new.uid""",
    "merge_edges": _g("SELECT * FROM edges"),
    "existing_uids": _g(f"""SELECT DISTINCT source_uid AS uid, source_uid IN (SELECT {_CL} FROM clauses) AS found FROM e_contains"""),
    "delete_document": _g("""
        , gone AS (SELECT uid FROM nodes WHERE document_id IN (SELECT 'doc' || doc_id FROM labels WHERE toxic = 1)),
        n2 AS (SELECT * FROM nodes WHERE uid NOT IN (SELECT uid FROM gone)),
        e2 AS (SELECT * FROM edges WHERE source_uid NOT IN (SELECT uid FROM gone) AND target_uid NOT IN (SELECT uid FROM gone))
        """ + _STATS.format(n="n2", e="e2")),
    "graph_statistics": _g(_STATS.format(n="nodes", e="edges")),
    "graph_transactions": _g("""
        , n AS (SELECT document_id, count(*) AS c FROM sent_n WHERE document_id IS NOT NULL GROUP BY 1),
        d AS (SELECT document_id, count(*) AS c FROM nodes WHERE document_id IS NOT NULL GROUP BY 1),
        e AS (SELECT document_id, count(*) AS c FROM sent_e GROUP BY 1),
        s AS (SELECT document_id, count(*) AS c FROM (SELECT DISTINCT document_id, source_uid, rel_type, target_uid FROM sent_e
          WHERE source_uid IN (SELECT uid FROM nodes) AND target_uid IN (SELECT uid FROM nodes)) GROUP BY 1)
        SELECT sha256(document_id || ':')[1:16] AS transaction_id, document_id, CAST(NULL AS VARCHAR) AS document_hash,
          CASE WHEN failed = 0 THEN 'completed' ELSE 'failed' END AS status,
          CASE WHEN failed > 0 THEN 'Validation failed: ' || failed || ' chunks invalid' END AS error_message,
          CASE WHEN failed = 0 THEN n.c ELSE 0 END AS nodes_sent, CASE WHEN failed = 0 THEN d.c ELSE 0 END AS nodes_stored,
          CASE WHEN failed = 0 THEN e.c ELSE 0 END AS edges_sent,
          CASE WHEN failed = 0 THEN coalesce(s.c, 0) ELSE 0 END AS edges_stored
        FROM gate JOIN n USING (document_id) JOIN d USING (document_id) JOIN e USING (document_id) LEFT JOIN s USING (document_id)"""),
    "clause_counts": "WITH RECURSIVE " + SQL_GRAPH.strip() + """,
        walk AS (SELECT document_id, uid FROM nodes WHERE label = 'Document'
          UNION ALL SELECT w.document_id, e.target_uid FROM walk w JOIN edges e ON e.source_uid = w.uid AND e.rel_type = 'CONTAINS')
        SELECT document_id, count(*) - 1 AS clause_count FROM walk GROUP BY document_id""",
    "list_graph_documents": fx.with_ctes(fx.numbers_end(SQL_GRAPH), "SELECT document_id, total_clauses FROM stats"),
    "build_graph": _g("""SELECT label, count(*) AS n, count(DISTINCT uid) AS uids FROM nodes GROUP BY label
        UNION ALL SELECT rel_type, count(*), count(DISTINCT target_uid) FROM edges GROUP BY rel_type"""),
}
