"""Queries over retrieval and grounding."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from clauseloom.catalog import fixtures as fx
from clauseloom.catalog import graph as cg
from clauseloom.catalog.structure import long_chunks, one_document
from clauseloom.operators import graph as gr
from clauseloom.operators import grounding as gd
from clauseloom.operators import retrieval as rt
from clauseloom.operators import structure as st
from clauseloom.operators.vector_index import VectorIndex
from clauseloom.plans.stage import fresh_path, settled, stage


def _vectors(spark, sf):
    return fx.read(spark, sf, "embeddings")


def centroids(spark, sf):
    """One query per label: the mean of its vectors."""
    dims = _vectors(spark, sf).selectExpr("label", "posexplode(embedding) AS (i, x)")
    means = dims.groupBy("label", "i").agg(F.expr("avg(CAST(x AS DOUBLE))").alias("m"))
    return means.groupBy("label").agg(F.expr("transform(array_sort(collect_list(struct(i, m))), x -> x.m)").alias("embedding")).selectExpr(
        "CAST(label AS BIGINT) AS query_id", "label", "embedding")


def _rounded(df):
    return df.withColumn("score", F.expr("round(score, 6)"))


def _asked(vectors, rest):
    """One vector in fifty as a query."""
    return vectors.filter(f"vec_id % 50 = {rest}").selectExpr("vec_id AS query_id", "embedding")


def _index(spark, vectors):
    return VectorIndex.create(vectors, fresh_path(spark, "vector-index"))


def ann_search(spark, sf):
    """As many lists probed as sample queries need."""
    vectors = _vectors(spark, sf)
    index = _index(spark, vectors)
    return _rounded(index.search(centroids(spark, sf), 10, index.probes_for(_asked(vectors, 25), 10)))


def ann_search_all_lists(spark, sf):
    """Probing every list by its vectors is exact."""
    index = _index(spark, _vectors(spark, sf))
    return _rounded(index.search(centroids(spark, sf), 10, len(index.model.centres), exact_lists=True))


def _appended(spark, sf):
    """An index of three quarters of the vectors that gets the others later."""
    vectors = _vectors(spark, sf)
    index = _index(spark, vectors.filter("vec_id % 4 <> 0"))
    index.append(vectors.filter("vec_id % 4 = 0"), writer="later", batch=0)
    index.append(vectors.filter("vec_id % 4 = 0"), writer="later", batch=0)
    return index


def ann_append(spark, sf):
    index = _appended(spark, sf)
    return _rounded(index.search(centroids(spark, sf), 10, len(index.model.centres), exact_lists=True))


def _texts(chunks, passage_chars=8000):
    return rt.embedding_text(chunks, passage_chars, 2000).selectExpr(
        "document_id", "chunk_id", "passage", "md5(embed_text) AS embed_hash", "length(content) AS kept")


def embed_chunks(spark, sf):
    return rt.embed_chunks(rt.embedding_text(cg.chunks(spark, sf))).selectExpr(
        "uid", "passage", "size(embedding) AS dim", "round(aggregate(embedding, 0D, (a, x) -> a + x * x), 3) AS norm")


#: Least share of the exact ten nearest that the inverted lists must find.
LEAST_RECALL = 0.9


def _recall(spark, sf, index):
    """Probes chosen on some rows as queries, the recall measured on others."""
    vectors = _vectors(spark, sf)
    probe = index.probes_for(_asked(vectors, 25), 10)
    exact = stage(rt.vector_search(_asked(vectors, 0), vectors, 10).select("query_id", "vec_id"), "exact")
    found = index.recall(_asked(vectors, 0), 10, probe, exact)
    return exact.agg(F.expr("count(DISTINCT query_id)").alias("queries"), F.expr("count(*)").alias("wanted")).withColumn(
        "enough", F.lit(found >= LEAST_RECALL))


def ann_recall(spark, sf):
    return _recall(spark, sf, _index(spark, _vectors(spark, sf)))


def ann_append_recall(spark, sf):
    return _recall(spark, sf, _appended(spark, sf))


def _everybody(vectors):
    return vectors.selectExpr("vec_id AS query_id", "embedding", "label")


def vector_search_grid(spark, sf):
    """Every vector as a query, in blocks of 64: one read of the vectors for all of them."""
    vectors = _vectors(spark, sf)
    return _rounded(rt.vector_search(_everybody(vectors), vectors, 5, block=64))


def vector_search_grid_filtered(spark, sf):
    """Every vector asks for those of its label, each seventh for all."""
    vectors = _vectors(spark, sf)
    asked = _everybody(vectors).withColumn("label", F.expr("CASE WHEN query_id % 7 <> 0 THEN label END"))
    return _rounded(rt.vector_search(asked, vectors, 5, match="label", block=64))


#: How often each letter stands in a text, as its vector: whole numbers, so that equal texts tie exactly.
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_COUNTS = ", ".join(f"CAST(length(text) - length(replace(replace(text, '{c}', ''), '{c.upper()}', '')) AS DOUBLE)" for c in _LETTERS)


def _letters(col):
    """The counts of ``_COUNTS`` in one pass over the bytes of a text."""
    places = np.frombuffer(_LETTERS.encode(), np.uint8)

    @F.pandas_udf("array<double>")
    def counted(texts: pd.Series) -> pd.Series:
        bytes_of = (None if t is None else np.bincount(np.frombuffer(t, np.uint8), minlength=256) for t in texts)
        return pd.Series([None if n is None else (n[places] + n[places - 32]).astype("float64") for n in bytes_of], dtype=object)

    return counted(F.encode(col, "UTF-8")).alias("embedding")


def message_search(spark, sf):
    """All that users wrote, every message at once, against all documents."""
    documents = fx.spread_small(fx.read(spark, sf, "documents").select("doc_id", "text"))
    asked = fx.spread_small(fx.read(spark, sf, "conversations").filter("role = 'user'").selectExpr("conv_id * 1000 + turn AS query_id", "text"))
    # Written, so that no filter on the counts counts again.
    documents = stage(documents.select(F.col("doc_id").alias("vec_id"), _letters("text")), "letters")
    asked = stage(asked.select("query_id", _letters("text")), "letters")
    return _rounded(rt.vector_search(asked, documents, 5, block=256))


def _seeds(nodes):
    """One query per document: its three longest clauses stand for what a vector search returns."""
    ranked = nodes.filter("label = 'Clause'").selectExpr(
        "CAST(substring(document_id, 4) AS BIGINT) AS query_id", "uid", "document_id", "title", "content_text AS content",
        "CAST(content_length AS DOUBLE) AS score")
    return rt.top_per_key(ranked, ["query_id"], ["score DESC", "uid"], 3)


def _context(spark, sf):
    nodes, edges = cg.stored_graph(spark, sf)
    return rt.anchor_expand(_seeds(nodes), nodes, edges), nodes, edges


def expand_context(spark, sf):
    nodes, edges = cg.stored_graph(spark, sf)
    return rt.expand_context(_seeds(nodes), nodes, edges).selectExpr(
        "query_id", "seed_uid", "seed_rank", "rel_rank", "uid", "title", "md5(content) AS content_hash", "node_type")


def anchor_expand(spark, sf):
    return _context(spark, sf)[0].selectExpr(
        "query_id", "uid", "is_expansion", "rank", "score", "retrieval_score", "node_type", "title", "md5(content) AS content_hash")


def graph_expand(spark, sf):
    nodes, edges = cg.stored_graph(spark, sf)
    return rt.graph_expand(nodes.filter("label = 'Clause'"), nodes, edges).selectExpr(
        "uid", "relation", "id", "title", "md5(content) AS content_hash", "tables", "figures")


def _two_lists(spark, sf):
    li = fx.read(spark, sf, "lineitem").selectExpr("l_suppkey AS query_id", "concat('p', l_partkey) AS uid", "l_discount", "l_tax")
    v = li.groupBy("query_id", "uid").agg(F.max("l_discount").alias("score"))
    g = li.groupBy("query_id", "uid").agg(F.max("l_tax").alias("score"))
    num = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, uid) AS rank"
    return v.selectExpr("*", num), g.selectExpr("*", num)


def hybrid_fuse(spark, sf):
    """Scores in whole hundredths, so that rounding cannot swap two ranks."""
    return _rounded(rt.hybrid_fuse(*_two_lists(spark, sf)))


def hybrid_fuse_rrf(spark, sf):
    return rt.hybrid_fuse(*_two_lists(spark, sf), method="rrf").selectExpr("query_id", "uid", "round(score, 9) AS score")


def assemble_context(spark, sf):
    context = stage(_context(spark, sf)[0].filter("rank <= 8"), "context")
    plain = rt.assemble_context(context, 5).selectExpr("query_id", "'plain' AS form", "md5(context) AS context_hash")
    return plain.unionByName(rt.assemble_context(context, 8, "tagged").selectExpr(
        "query_id", "'tagged' AS form", "md5(context) AS context_hash"))


def answer_context(spark, sf):
    """What users wrote, as questions to the clauses of all documents."""
    rows, counts = cg.chunks_and_stats(spark, sf)
    nodes, edges = settled(lambda: gr.build_graph(gr.uniform_chunks(rows), counts), "graph")
    asked = fx.read(spark, sf, "conversations").filter("role = 'user'").selectExpr("conv_id * 1000 + turn AS query_id", "text")
    return rt.answer_context(asked, rt.embedding_text(rows), nodes, edges, n=8, by_clause=True)


def document_requirements(spark, sf):
    context, _, _ = _context(spark, sf)
    asked = fx.read(spark, sf, "documents").selectExpr("doc_id AS query_id", "concat('doc', doc_id) AS document_id")
    kept = rt.document_requirements(context, asked)
    return gd.classify_requirements(kept).selectExpr(
        "query_id", "requirement_id", "source_chunk_id", "requirement_type", "md5(description) AS description_hash")


def retrieval_audit(spark, sf):
    context, _, _ = _context(spark, sf)
    asked = fx.read(spark, sf, "documents").selectExpr("doc_id AS query_id", "text")
    return rt.retrieval_audit(context, asked)


def plan_audit(spark, sf):
    return gd.plan_audit(_context(spark, sf)[0])


_WORDS = {"mandatory": ["the", "que"], "recommended": ["and", "und"], "optional": ["of", "los"]}


def classify_requirements(spark, sf):
    """Benchmark passages and messages as context; word groups that occur in them."""
    msgs = fx.read(spark, sf, "conversations").selectExpr(
        "conv_id AS query_id", "turn + 1 AS rank", "concat(conv_id, ':', turn) AS uid", "text AS content")
    return gd.classify_requirements(msgs, _WORDS)


def answers(spark, sf):
    """An answer per document: prose around a JSON plan, a broken one, or none."""
    return fx.read(spark, sf, "documents").selectExpr(
        "doc_id AS query_id",
        """CASE doc_id % 5 WHEN 0 THEN concat('Sure. ', regexp_replace(text, '[{}]', ''), ' {"test_plan_summary": ')
           WHEN 1 THEN regexp_replace(text, '[{}]', '')
           ELSE concat('Here is the plan: ', to_json(named_struct('test_plan_summary', source, 'applicable_standard', lang,
             'sources_used', array(concat('s', doc_id % 7), concat('s', doc_id % 3)),
             'test_cases', array(
               named_struct('id', CASE WHEN doc_id % 2 = 0 THEN 'TC_A' END, 'procedure', text,
                 'equipment_required', array(lang, source), 'source_chunks', array(concat('s', doc_id % 4))),
               named_struct('id', 'TC_B', 'procedure', '', 'equipment_required', array(lang), 'source_chunks', array('s9', 's1'))))),
             ' Done.') END AS response""")


def plans(spark, sf):
    return gd.extract_json(answers(spark, sf), "response")


def _plan_context(spark, sf):
    sources = fx.read(spark, sf, "documents").selectExpr("doc_id AS query_id", "explode(sequence(0, 3)) AS i")
    return sources.selectExpr("query_id", "concat('s', i) AS uid")


def groundedness(spark, sf):
    texts = fx.spread_small(fx.read(spark, sf, "documents").selectExpr("doc_id AS text_id", "text"))
    context = fx.read(spark, sf, "benchmark").selectExpr("text AS content")
    return gd.groundedness(texts, context)[0].selectExpr("text_id", "grounded", "sentences", "round(score, 6) AS score")


def groundedness_flagged(spark, sf):
    """Messages of the assistant against what the user wrote in the same conversation."""
    msgs = fx.read(spark, sf, "conversations")
    texts = msgs.filter("role = 'assistant'").selectExpr("conv_id * 1000 + turn AS text_id", "conv_id", "text")
    context = msgs.filter("role = 'user'").selectExpr("conv_id", "text AS content")
    return gd.groundedness(texts, context, 0.5, on="conv_id")[1]


def _reqs(spark, sf):
    return fx.read(spark, sf, "part").selectExpr(
        "concat('REQ-', p_partkey) AS requirement_id", "p_type AS requirement_text",
        "CASE p_size % 4 WHEN 0 THEN 'mandatory' WHEN 1 THEN 'prohibition' WHEN 2 THEN 'recommendation' ELSE 'permission' END AS type",
        "p_brand AS source_clause")


def _cases(spark, sf):
    return fx.read(spark, sf, "lineitem").selectExpr(
        "concat('REQ-', l_partkey) AS requirement_id", "concat('TC-', l_orderkey) AS test_case_id")


def coverage(spark, sf):
    return gd.coverage_matrix(_reqs(spark, sf), _cases(spark, sf))


def covered_by(spark, sf):
    return gd.covered_by(_reqs(spark, sf), _cases(spark, sf))


def test_type_lookup(spark, sf):
    content = st.content_blocks(st.assign_blocks(fx.document_blocks(spark, sf)))
    refs = st.extract_references(content).filter("reference_type = 'standard'").selectExpr(
        "document_id", "pos", "concat(target, ':2012') AS standard")
    return gd.test_type_lookup(refs)


def message_intent(spark, sf):
    msgs = fx.read(spark, sf, "conversations").selectExpr("conv_id", "turn", "text")
    # Whole messages, and the first word of the second as a message of its own.
    msgs = msgs.unionByName(msgs.filter("turn = 2").selectExpr("conv_id", "-1 AS turn", "concat(substring(text, 1, instr(text, ' ') - 1), '!') AS text"))
    return gd.message_intent(msgs, "text", phrases=["the of", "que le", "in the"], greetings=["the", "que", "in", "and"]).drop("text")


QUERIES = {
    "embedding_text": lambda s, d: _texts(cg.chunks(s, d)),
    "embedding_text_long": lambda s, d: _texts(long_chunks(s, d), 1000),
    "ann_recall": ann_recall,
    "embed_chunks": embed_chunks,
    "answer_context": answer_context,
    "vector_search": lambda s, d: _rounded(rt.vector_search(centroids(s, d), _vectors(s, d), 10)),
    "vector_search_filtered": lambda s, d: _rounded(rt.vector_search(centroids(s, d), _vectors(s, d), 10, match="label")),
    "vector_search_grid": vector_search_grid,
    "vector_search_grid_filtered": vector_search_grid_filtered,
    "message_search": message_search,
    "ann_append": ann_append,
    "ann_append_recall": ann_append_recall,
    "ann_search": ann_search,
    "ann_search_all_lists": ann_search_all_lists,
    "expand_context": expand_context,
    "anchor_expand": anchor_expand,
    "graph_expand": graph_expand,
    "hybrid_fuse": hybrid_fuse,
    "hybrid_fuse_rrf": hybrid_fuse_rrf,
    "assemble_context": assemble_context,
    "document_requirements": document_requirements,
    "retrieval_audit": retrieval_audit,
    "plan_audit": plan_audit,
    "classify_requirements": classify_requirements,
    "context_requirements_by_type": lambda s, d: gd.requirements_by_type(classify_requirements(s, d), "query_id", list(_WORDS), "requirement_type"),
    "extract_json": lambda s, d: plans(s, d).selectExpr("query_id", "length(json) AS json_length", "parsed.test_plan_summary AS summary", "size(parsed.test_cases) AS n_cases"),
    "validate_sources": lambda s, d: gd.validate_sources(plans(s, d), _plan_context(s, d)),
    "source_warnings": lambda s, d: gd.source_warnings(plans(s, d), _plan_context(s, d)),
    "test_cases": lambda s, d: gd.test_cases(plans(s, d)).selectExpr("query_id", "id", "requirement_type", "procedure", "array_join(equipment_required, '|') AS equipment", "array_join(source_chunks, '|') AS sources"),
    "plan_rollup": lambda s, d: gd.plan_rollup(gd.test_cases(plans(s, d)), plans(s, d)),
    "groundedness": groundedness,
    "groundedness_flagged": groundedness_flagged,
    "requirement_priority": lambda s, d: gd.requirement_priority(_reqs(s, d)),
    "coverage_matrix": coverage,
    "covered_by": covered_by,
    "coverage_summary": lambda s, d: gd.coverage_summary(coverage(s, d)),
    "test_type_lookup": test_type_lookup,
    "message_intent": message_intent,
}

_COS = """
means AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i
   FROM embeddings) GROUP BY ALL),
qs AS (SELECT label, list(m ORDER BY i) AS q FROM means GROUP BY label),
sims AS (SELECT q.label AS query_id, v.vec_id, v.label,
   list_dot_product(q.q, v.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.q, q.q)) * sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[]))) AS s
   FROM qs q, embeddings v)"""
_TOPK = """SELECT query_id, vec_id, round(s, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank
   FROM sims {where}) WHERE rank <= 10"""

_GRID = """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS l FROM embeddings),
    sims AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e) / (q.l * v.l) AS s FROM v AS q, v {where})
    SELECT query_id, vec_id, round(s, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM sims)
    WHERE rank <= 5"""

#: CTEs down to ``ctx``: seeds, their neighbours and the numbered context.
SQL_CONTEXT = (
    cg.SQL_GRAPH
    + f""",
full_nodes AS (
   SELECT 'document:' || document_id AS uid, 'Document' AS label, document_id, CAST(NULL AS VARCHAR) AS title, CAST(NULL AS VARCHAR) AS content,
     CAST(NULL AS VARCHAR) AS caption, CAST(NULL AS VARCHAR) AS num FROM stats
   UNION ALL SELECT {cg._CL}, 'Clause', document_id, title, content_text, NULL, NULL FROM levels
   UNION ALL SELECT uid, 'Table', document_id, NULL, NULL, max(caption), max(table_number) FROM tab_n GROUP BY uid, document_id
   UNION ALL SELECT uid, 'Figure', document_id, NULL, NULL, max(caption), max(number) FROM fig_n GROUP BY uid, document_id
   UNION ALL SELECT DISTINCT uid, 'Standard', NULL, NULL, NULL, NULL, NULL FROM std),
seeds AS (SELECT * FROM (SELECT CAST(document_id[4:] AS BIGINT) AS query_id, {cg._CL} AS uid, document_id, title, content_text AS content,
   CAST(length(content_text) AS DOUBLE) AS score,
   row_number() OVER (PARTITION BY document_id ORDER BY length(content_text) DESC, {cg._CL}) AS rank FROM levels) WHERE rank <= 3),
links AS (SELECT target_uid AS seed_uid, source_uid AS n_uid, 1 AS rel_rank FROM edges WHERE rel_type = 'CONTAINS'
   UNION ALL SELECT source_uid, target_uid, CASE rel_type WHEN 'CONTAINS' THEN 2 WHEN 'HAS_TABLE' THEN 4 WHEN 'HAS_FIGURE' THEN 5 ELSE 3 END
   FROM edges WHERE rel_type <> 'REQUIRES'),
near AS (SELECT s.query_id, s.uid AS seed_uid, s.rank AS seed_rank, l.rel_rank, n.uid, n.label AS node_type,
   CASE WHEN rel_rank <= 2 THEN split_part(s.uid, ':', 2) ELSE '' END AS document_id,
   CASE rel_rank WHEN 4 THEN 'Table ' || num || ': ' || coalesce(nullif(caption, ''), 'Data Table')
     WHEN 5 THEN 'Figure ' || num || ': ' || coalesce(nullif(caption, ''), 'Diagram')
     ELSE coalesce(nullif(n.title, ''), CASE rel_rank WHEN 1 THEN 'Parent Section' WHEN 2 THEN 'Sub-section' ELSE 'Referenced Section' END) END AS title,
   CASE rel_rank WHEN 4 THEN '[Table ' || num || ' - See source document]' WHEN 5 THEN '[Figure ' || num || ' - See source document]'
     ELSE coalesce(n.content, '') END AS content
   FROM seeds s JOIN links l ON l.seed_uid = s.uid JOIN full_nodes n ON n.uid = l.n_uid),
every AS (SELECT query_id, uid, false AS is_expansion, rank AS seed_rank, 0 AS rel_rank, document_id, title, content, 'Clause' AS node_type, score, score AS retrieval_score FROM seeds
   UNION ALL SELECT query_id, uid, true, seed_rank, rel_rank, document_id, title, content, node_type, 0, 0.5 FROM near),
firsts AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY query_id, uid ORDER BY is_expansion, seed_rank, rel_rank) = 1),
ctx AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY is_expansion, seed_rank, rel_rank, md5(uid)[1:2], uid) AS rank FROM firsts)"""
)


def _c(select):
    return fx.with_ctes(SQL_CONTEXT, select)


_REQ_CASE = """CASE WHEN contains(lower(content), 'shall') OR contains(lower(content), 'must') OR contains(lower(content), 'required')
   OR contains(lower(content), 'mandatory') THEN 'mandatory' WHEN contains(lower(content), 'should') OR contains(lower(content), 'recommended')
   OR contains(lower(content), 'advisable') THEN 'recommended' WHEN contains(lower(content), 'may') OR contains(lower(content), 'optional')
   OR contains(lower(content), 'permitted') THEN 'optional' END"""
_MSG_REQ = """
typed AS (SELECT conv_id AS query_id, turn, conv_id || ':' || turn AS source_chunk_id, text[1:500] AS description,
  CASE WHEN contains(lower(text), 'the') OR contains(lower(text), 'que') THEN 'mandatory'
    WHEN contains(lower(text), 'and') OR contains(lower(text), 'und') THEN 'recommended'
    WHEN contains(lower(text), 'of') OR contains(lower(text), 'los') THEN 'optional' END AS requirement_type FROM conversations),
found AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY turn) AS n FROM typed WHERE requirement_type IS NOT NULL)"""
_PLANS = """
good AS (SELECT doc_id AS query_id, doc_id, text, lang, source FROM documents WHERE doc_id % 5 >= 2),
cited AS (SELECT query_id, NULL AS case_id, unnest(['s' || doc_id % 7, 's' || doc_id % 3]) AS source FROM good
  UNION ALL SELECT query_id, CASE WHEN doc_id % 2 = 0 THEN 'TC_A' ELSE 'TC_001' END, 's' || doc_id % 4 FROM good
  UNION ALL SELECT query_id, 'TC_B', unnest(['s9', 's1']) FROM good),
warned AS (SELECT * FROM cited WHERE source NOT IN ('s0', 's1', 's2', 's3'))"""
_SENT = """
sents AS (SELECT {key}, unnest(list_filter(list_transform(string_split(regexp_replace(text, '([.?])', '\\1|', 'g'), '|'),
    lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')) AS sentence,
  unnest(range(len(list_filter(list_transform(string_split(regexp_replace(text, '([.?])', '\\1|', 'g'), '|'),
    lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')))) AS sentence_no FROM {src}),
words AS (SELECT DISTINCT {key}, sentence_no, w FROM (SELECT {key}, sentence_no, unnest(regexp_split_to_array(lower(sentence), '\\s+')) AS w FROM sents) WHERE w <> '')"""
_REQS = """
reqs AS (SELECT 'REQ-' || p_partkey AS requirement_id, p_type AS requirement_text, p_brand AS source_clause,
  CASE p_size % 4 WHEN 0 THEN 'mandatory' WHEN 1 THEN 'prohibition' WHEN 2 THEN 'recommendation' ELSE 'permission' END AS type FROM part),
links AS (SELECT DISTINCT 'REQ-' || l_partkey AS requirement_id, 'TC-' || l_orderkey AS test_case_id FROM lineitem),
matrix AS (SELECT r.*, count(test_case_id) AS n_tests, min(test_case_id) AS first_test,
  CASE WHEN count(test_case_id) > 0 THEN 'covered' ELSE 'not_covered' END AS coverage_status
  FROM reqs r LEFT JOIN links USING (requirement_id) GROUP BY ALL)"""
_FUSE = """
li AS (SELECT l_suppkey AS query_id, 'p' || l_partkey AS uid, max(l_discount) AS d, max(l_tax) AS t FROM lineitem GROUP BY ALL),
v AS (SELECT query_id, uid, d AS score, row_number() OVER (PARTITION BY query_id ORDER BY d DESC, uid) AS r FROM li),
g AS (SELECT query_id, uid, t AS score, row_number() OVER (PARTITION BY query_id ORDER BY t DESC, uid) AS r FROM li)"""


def _passages(columns, chars):
    return f"""SELECT document_id, chunk_id, CAST(p AS INTEGER) AS passage, {columns} FROM (
      SELECT document_id, chunk_id, p, full_text[p * {chars} + 1:(p + 1) * {chars}] AS t FROM (
        SELECT document_id, clause_id AS chunk_id, title || '. ' || content_text AS full_text,
          unnest(range((length(title || '. ' || content_text) + {chars} - 1) // {chars})) AS p FROM levels))"""


SQL = {
    "embedding_text": fx.with_ctes(fx.SQL_PARTS, _passages("md5(t) AS embed_hash, least(length(t), 2000) AS kept", 8000)),
    "embedding_text_long": fx.with_ctes(one_document(fx.SQL_PARTS), _passages("md5(t) AS embed_hash, least(length(t), 2000) AS kept", 1000)),
    "embed_chunks": f"SELECT 'clause:' || document_id || ':' || chunk_id AS uid, passage, 384 AS dim, 1.0::DOUBLE AS norm FROM ("
    + fx.with_ctes(fx.SQL_PARTS, _passages("1", 8000)) + ")",
    "ann_recall": "SELECT count(*) AS queries, 10 * count(*) AS wanted, true AS enough FROM embeddings WHERE vec_id % 50 = 0",
    "vector_search_grid": _GRID.format(where=""),
    "vector_search_grid_filtered": _GRID.format(where="WHERE q.vec_id % 7 = 0 OR q.label = v.label"),
    "message_search": f"""WITH d AS (SELECT doc_id AS vec_id, [{_COUNTS}] AS v FROM documents WHERE text IS NOT NULL),
        q AS (SELECT conv_id * 1000 + turn AS query_id, any_value([{_COUNTS}]) AS v FROM conversations WHERE role = 'user' AND text IS NOT NULL GROUP BY ALL),
        sims AS (SELECT query_id, vec_id, sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(d.v, d.v)) AS l, list_dot_product(q.v, d.v) AS p FROM q, d),
        scored AS (SELECT query_id, vec_id, CASE WHEN l > 0 THEN p / l ELSE 0 END AS s FROM sims)
        SELECT query_id, vec_id, round(s, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM scored)
        WHERE rank <= 5""",
    "ann_append": fx.with_ctes(_COS, _TOPK.format(where="")),
    "ann_append_recall": "SELECT count(*) AS queries, 10 * count(*) AS wanted, true AS enough FROM embeddings WHERE vec_id % 50 = 0",
    "ann_search_all_lists": fx.with_ctes(_COS, _TOPK.format(where="")),
    "vector_search": fx.with_ctes(_COS, _TOPK.format(where="")),
    "vector_search_filtered": fx.with_ctes(_COS, _TOPK.format(where="WHERE label = query_id")),
    "expand_context": _c("SELECT query_id, seed_uid, seed_rank, rel_rank, uid, title, md5(content) AS content_hash, node_type FROM near"),
    "anchor_expand": _c("SELECT query_id, uid, is_expansion, rank, score, retrieval_score, node_type, title, md5(content) AS content_hash FROM ctx"),
    "graph_expand": _c(f"""SELECT {cg._CL} AS uid, 'self' AS relation, clause_id AS id, title, md5(content_text) AS content_hash,
          (SELECT count(*) FROM edges WHERE source_uid = 'clause:' || l.document_id || ':' || l.clause_id AND rel_type = 'HAS_TABLE') AS tables,
          (SELECT count(*) FROM edges WHERE source_uid = 'clause:' || l.document_id || ':' || l.clause_id AND rel_type = 'HAS_FIGURE') AS figures FROM levels l
        UNION ALL SELECT source_uid, 'child', c.clause_id, c.title, NULL, NULL, NULL FROM edges JOIN clauses c ON target_uid = {cg._CL}
          WHERE rel_type = 'CONTAINS' AND source_uid LIKE 'clause:%'
        UNION ALL SELECT target_uid, 'parent', c.clause_id, c.title, NULL, NULL, NULL FROM edges JOIN clauses c ON source_uid = {cg._CL} WHERE rel_type = 'CONTAINS'"""),
    "hybrid_fuse": fx.with_ctes(_FUSE, """SELECT query_id, uid, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, uid) AS rank
        FROM (SELECT coalesce(v.query_id, g.query_id) AS query_id, coalesce(v.uid, g.uid) AS uid,
          0.6::DOUBLE * coalesce(v.score, 0) + 0.4::DOUBLE * coalesce(g.score, 0) AS s FROM v FULL JOIN g ON v.query_id = g.query_id AND v.uid = g.uid)"""),
    "hybrid_fuse_rrf": fx.with_ctes(_FUSE, """SELECT coalesce(v.query_id, g.query_id) AS query_id, coalesce(v.uid, g.uid) AS uid,
        round(coalesce(1.0::DOUBLE / (60 + v.r), 0) + coalesce(1.0::DOUBLE / (60 + g.r), 0), 9) AS score FROM v FULL JOIN g ON v.query_id = g.query_id AND v.uid = g.uid"""),
    "assemble_context": _c("""SELECT query_id, 'plain' AS form, md5(string_agg('[SOURCE: ' || uid || ']' || chr(10) || coalesce(title, '') || chr(10) || coalesce(content, ''), chr(10) || chr(10) ORDER BY rank)) AS context_hash
          FROM ctx WHERE rank <= 5 GROUP BY query_id
        UNION ALL SELECT query_id, 'tagged', md5(string_agg(chr(10) || '[SOURCE: ' || uid || ']' || chr(10) || '[TYPE: ' || node_type || ']' || chr(10) || '[TITLE: ' || title || ']' || chr(10) || '[CONTENT:]' || chr(10) || content || chr(10) || '[END SOURCE]' || chr(10), chr(10) ORDER BY rank))
          FROM ctx WHERE rank <= 8 GROUP BY query_id"""),
    "document_requirements": _c(f"""SELECT query_id, 'REQ_' || lpad(CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS VARCHAR), 3, '0') AS requirement_id,
        uid AS source_chunk_id, requirement_type, md5(content[1:500]) AS description_hash
        FROM (SELECT *, {_REQ_CASE} AS requirement_type FROM ctx WHERE contains(uid, 'doc' || query_id) OR contains(document_id, 'doc' || query_id)) WHERE requirement_type IS NOT NULL"""),
    "retrieval_audit": _c("""SELECT query_id, 'retrieve_grounded_context' AS action, md5(text)[1:16] AS query_hash, rank, uid AS chunk_id, retrieval_score
        FROM ctx JOIN documents ON doc_id = query_id"""),
    "plan_audit": _c("""SELECT query_id, rank, uid AS chunk_id, CASE WHEN score > 0 THEN 'seed' WHEN score = 0 THEN 'expanded' END AS role,
        count(*) OVER (PARTITION BY query_id) AS total_context_chunks FROM ctx"""),
    "classify_requirements": fx.with_ctes(_MSG_REQ, """SELECT query_id, 'REQ_' || lpad(CAST(n AS VARCHAR), 3, '0') AS requirement_id,
        source_chunk_id, requirement_type, description FROM found"""),
    "context_requirements_by_type": fx.with_ctes(_MSG_REQ, """SELECT query_id, count(*) FILTER (requirement_type = 'mandatory') AS mandatory,
        count(*) FILTER (requirement_type = 'recommended') AS recommended, count(*) FILTER (requirement_type = 'optional') AS optional FROM found GROUP BY query_id"""),
    "validate_sources": fx.with_ctes(_PLANS, """SELECT query_id, count(w.source) AS warnings, count(w.source) = 0 AS is_valid
        FROM (SELECT query_id FROM good) LEFT JOIN warned w USING (query_id) GROUP BY query_id"""),
    "source_warnings": fx.with_ctes(_PLANS, """SELECT query_id, case_id, source, CASE WHEN case_id IS NULL THEN 'Referenced source ''' || source || ''' not in provided context'
        ELSE 'Test case ' || case_id || ' references unknown source ''' || source || '''' END AS warning FROM warned"""),
    "test_cases": fx.with_ctes(_PLANS, """SELECT query_id, CASE WHEN doc_id % 2 = 0 THEN 'TC_A' ELSE 'TC_001' END AS id, 'informative' AS requirement_type,
          text AS procedure, lang || '|' || source AS equipment, 's' || doc_id % 4 AS sources FROM good
        UNION ALL SELECT query_id, 'TC_B', 'informative', '', lang, 's9|s1' FROM good"""),
    "plan_rollup": fx.with_ctes(_PLANS, """SELECT query_id, lang AS applicable_standard, 2 AS total_test_cases, 2 AS equipment,
        CASE WHEN doc_id % 7 = doc_id % 3 THEN 1 ELSE 2 END AS sources FROM good"""),
    "extract_json": """SELECT doc_id AS query_id, length('{"test_plan_summary":"' || source || '","applicable_standard":"' || lang || '","sources_used":["s' || doc_id % 7 || '","s' || doc_id % 3
          || '"],"test_cases":[{' || CASE WHEN doc_id % 2 = 0 THEN '"id":"TC_A",' ELSE '' END || '"procedure":' || CAST(to_json(text) AS VARCHAR) || ',"equipment_required":["' || lang || '","' || source
          || '"],"source_chunks":["s' || doc_id % 4 || '"]},{"id":"TC_B","procedure":"","equipment_required":["' || lang || '"],"source_chunks":["s9","s1"]}]}') AS json_length, source AS summary, 2 AS n_cases
        FROM documents WHERE doc_id % 5 >= 2 UNION ALL SELECT doc_id, NULL, NULL, NULL FROM documents WHERE doc_id % 5 < 2""",
    "groundedness": fx.with_ctes(_SENT.format(key="doc_id", src="documents") + """,
        known AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_split_to_array(lower(text), '\\s+')) AS w FROM benchmark) WHERE w <> ''),
        judged AS (SELECT doc_id, sentence_no, count(k.w) / count(*) >= 0.3 AS ok FROM words LEFT JOIN known k ON words.w = k.w GROUP BY ALL)""",
        """SELECT d.doc_id AS text_id, count(*) FILTER (ok) AS grounded, count(sentence_no) AS sentences,
        round(coalesce(count(*) FILTER (ok) / nullif(count(sentence_no), 0), 0), 6) AS score FROM documents d LEFT JOIN judged j USING (doc_id) GROUP BY d.doc_id"""),
    "groundedness_flagged": fx.with_ctes("said AS (SELECT conv_id * 1000 + turn AS text_id, text FROM conversations WHERE role = 'assistant')," + _SENT.format(key="text_id", src="said") + """,
        known AS (SELECT DISTINCT conv_id, w FROM (SELECT conv_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS w FROM conversations WHERE role = 'user') WHERE w <> ''),
        judged AS (SELECT text_id, sentence_no, count(k.w) / count(*) >= 0.5 AS ok FROM words LEFT JOIN known k ON words.w = k.w AND k.conv_id = text_id // 1000 GROUP BY ALL)""",
        "SELECT text_id, sentence_no, sentence FROM sents JOIN judged USING (text_id, sentence_no) WHERE NOT ok"),
    "requirement_priority": fx.with_ctes(_REQS, """SELECT requirement_id, requirement_text, type, source_clause, CASE type WHEN 'mandatory' THEN 'critical'
        WHEN 'prohibition' THEN 'high' WHEN 'recommendation' THEN 'medium' ELSE 'low' END AS priority FROM reqs"""),
    "coverage_matrix": fx.with_ctes(_REQS, "SELECT * FROM matrix"),
    "covered_by": fx.with_ctes(_REQS, "SELECT DISTINCT requirement_id, test_case_id FROM links WHERE requirement_id IN (SELECT requirement_id FROM reqs)"),
    "coverage_summary": fx.with_ctes(_REQS, """SELECT count(*) AS total_requirements, count(*) FILTER (n_tests > 0) AS covered_requirements,
        count(*) FILTER (n_tests = 0) AS not_covered, round(100.0 * count(*) FILTER (n_tests > 0) / count(*), 1) AS coverage_percentage FROM matrix"""),
    "test_type_lookup": fx.with_ctes(fx.SQL_PARTS + f""",
        m AS (SELECT DISTINCT document_id, pos, unnest(regexp_extract_all(text, '{cg._REF}((?:ISO/IEC|IEC|ISO|CISPR|EN)\\s+\\d+(?:-\\d+)*)', 1)) AS target FROM content),
        t(std, test_type) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in gd.TEST_TYPES)})""",
        "SELECT document_id, pos, target || ':2012' AS standard, coalesce(test_type, 'other') AS test_type FROM m LEFT JOIN t ON t.std = m.target"),
    "message_intent": """SELECT conv_id, turn, contains(lower(t), 'the of') OR contains(lower(t), 'que le') OR contains(lower(t), 'in the') AS is_test_plan_request,
        regexp_replace(trim(lower(t)), '[^\\p{L}\\p{N}_\\s]', '', 'g') IN ('the', 'que', 'in', 'and') AS is_greeting
        FROM (SELECT conv_id, turn, text AS t FROM conversations UNION ALL SELECT conv_id, -1, text[1:instr(text, ' ') - 1] || '!' FROM conversations WHERE turn = 2)""",
}
