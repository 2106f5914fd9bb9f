"""Queries over document structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauseloom.catalog import fixtures as fx
from clauseloom.functions import text as tx
from clauseloom.operators import structure as st
from clauseloom.plans.stage import settled


def _assigned(spark, sf):
    return st.assign_blocks(fx.document_blocks(spark, sf))


def _opened(spark, sf):
    return st.open_clauses(st.assign_blocks(st.headers_only(fx.document_blocks(spark, sf))))


def _tree(spark, sf):
    return st.clause_tree(st.clause_dim(_opened(spark, sf)))


def order_roots(spark, sf):
    """Of texts that may end in a number alone, which opens no clause."""
    opened = st.open_clauses(st.assign_blocks(st.headers_only(fx.document_blocks(spark, sf, numbers_end=True))))
    return st.order_roots(st.clause_tree(st.clause_dim(opened))).select("document_id", "clause_id", "sort_key")


def _chunks(spark, sf):
    return st.make_chunks(fx.document_blocks(spark, sf))


def requirements_by_type(spark, sf):
    reqs = st.extract_requirements(_assigned(spark, sf))
    return reqs.groupBy("document_id").agg(
        *[F.count_if(F.col("type") == t).alias(t) for t in tx.NORMATIVE_WORDS.values()]
    )


def strip_html_pages(spark, sf):
    return fx.read(spark, sf, "pages").selectExpr("page_id", f"{tx.strip_html('html')} AS text")


def caption_number(spark, sf):
    return fx.document_blocks(spark, sf).filter("block_type = 'Caption'").selectExpr(
        "document_id", "pos", f"{tx.table_number('html')} AS table_number", f"{tx.figure_number('html')} AS figure_number"
    )


def _listed(col, field):
    return f"array_join(transform({col}, x -> coalesce(x.{field}, '-')), '|')"


def make_chunks(spark, sf):
    return _chunks(spark, sf).selectExpr(
        "document_id", "chunk_id", "title", "parent_id",
        f"{_listed('content', 'type')} AS content_types",
        f"sha2({_listed('content', 'text')}, 256) AS content_hash",
        f"{_listed('tables', 'number')} AS table_numbers",
        f"{_listed('figures', 'number')} AS figure_numbers",
        f"{_listed('figures', 'path')} AS figure_paths",
        f"{_listed('requirements', 'keyword')} AS keywords",
        "array_join(children_ids, '|') AS children_ids",
    )


#: Positions per segment in the long-document queries, so that most clauses have many parts.
SHORT_SEGMENT = 64


def long_chunks(spark, sf):
    """All documents as one, cut into short segments."""
    return settled(lambda: [st.make_chunks(_one_document(spark, sf), segment_rows=SHORT_SEGMENT)], "long-chunks")[0]


def _levels(chunks):
    return st.chunk_levels(chunks).selectExpr(
        "document_id", "chunk_id", "level", "sha2(content_text, 256) AS text_hash", "content_length",
        "has_requirements", "has_tables", "has_figures",
    )


def dedup_references(spark, sf):
    found = ", ".join(f"'{n}', regexp_extract_all(t, {tx.quote(p)}, 1)" for n, p in tx.MENTIONS.items())
    return (
        fx.document_blocks(spark, sf)
        .selectExpr("document_id", r"concat_ws('\n', html, caption, html) AS t")
        .selectExpr("document_id", f"named_struct({found}) AS refs")
        .selectExpr("document_id", "refs", f"{tx.dedup_references('refs')} AS out")
        .groupBy("document_id")
        .agg(
            F.expr("sum(size(refs.clauses))").alias("clauses_listed"),
            F.expr("sum(size(refs.standards))").alias("standards_listed"),
            F.expr("sum(size(out.clauses))").alias("clauses_kept"),
            F.expr("sum(size(out.standards))").alias("standards_kept"),
        )
    )


def structure_basic(spark, sf):
    return st.make_chunks(fx.document_blocks(spark, sf), mode="basic").selectExpr(
        "document_id", "chunk_id", "size(content) AS n_content", f"{_listed('tables', 'caption')} AS captions",
        f"{_listed('figures', 'path')} AS paths", f"{_listed('figures', 'caption')} AS figure_captions",
        "size(requirements) AS n_requirements",
    )


def _one_document(spark, sf):
    """All documents as one, so that it spans many segments."""
    return fx.document_blocks(spark, sf).selectExpr(
        "'all' AS document_id", "CAST(substring(document_id, 4) AS BIGINT) * 4096 + pos AS pos", "block_type", "html",
        "caption", "rows", "images")


def make_chunks_long(spark, sf):
    parts = st.make_chunks(_one_document(spark, sf))
    return parts.groupBy("chunk_id").agg(
        F.expr("max(title)").alias("title"),
        F.expr("sum(size(content))").alias("n_content"), F.expr("sum(size(tables))").alias("n_tables"),
        F.expr("sum(size(requirements))").alias("n_requirements"), F.expr("sum(size(children_ids))").alias("n_children"),
        F.expr("sum(size(figures))").alias("n_figures"),
        F.expr("max(figures_before + size(figures))").alias("last_figure"),
    )


QUERIES = {
    "strip_html": strip_html_pages,
    "classify_header": lambda s, d: st.classify_headers(fx.document_blocks(s, d)),
    "open_clauses": _opened,
    "assign_clause": lambda s, d: _assigned(s, d).select("document_id", "pos", "block_type", "clause_id"),
    "pair_captions": lambda s, d: st.pair_captions(_assigned(s, d)),
    "extract_tables": lambda s, d: st.extract_tables(_assigned(s, d)).withColumn("rows", F.to_json("rows")),
    "extract_figures": lambda s, d: st.extract_figures(_assigned(s, d)).drop("img_no"),
    "content_blocks": lambda s, d: st.content_blocks(_assigned(s, d)),
    "extract_requirements": lambda s, d: st.extract_requirements(_assigned(s, d)),
    "requirements_by_type": requirements_by_type,
    "caption_number": caption_number,
    "clause_dim": lambda s, d: st.clause_dim(_opened(s, d)),
    "clause_tree": lambda s, d: _tree(s, d).select("document_id", "clause_id", "tree_parent_id"),
    "root_clauses": lambda s, d: st.root_clauses(_tree(s, d)).select("document_id", "clause_id", "title"),
    "order_roots": order_roots,
    "document_statistics": lambda s, d: st.document_statistics(_assigned(s, d)),
    "misc_images": lambda s, d: st.misc_images(_assigned(s, d)),
    "make_chunks": make_chunks,
    "chunk_levels": lambda s, d: _levels(_chunks(s, d)),
    "chunk_levels_long": lambda s, d: _levels(long_chunks(s, d)),
    "dedup_references": dedup_references,
    "extract_references": lambda s, d: st.extract_references(st.content_blocks(_assigned(s, d))),
    "structure_basic": structure_basic,
    "assign_long_document": lambda s, d: st.assign_blocks(_one_document(s, d)).select("pos", "clause_id", "opened_title", "caption_text"),
    "make_chunks_long_document": make_chunks_long,
}

_P = fx.SQL_PARTS


def one_document(ctes: str) -> str:
    """CTEs over the blocks of all documents as one document."""
    one = "blocks AS (SELECT 'all' AS document_id, doc_id * 4096 + pos AS pos, * EXCLUDE (document_id, pos) FROM own_blocks)"
    return ctes.replace("blocks AS (", "own_blocks AS (", 1).replace("texts AS (", one + ",\ntexts AS (", 1)


_ONE = one_document(fx.SQL_PARTS)
_LISTED = """
docs AS (SELECT document_id, concat_ws(chr(10), html, caption, html) AS t FROM blocks),
found AS (SELECT document_id,
  regexp_extract_all(t, '(?i)(?:^|[^\\p{L}\\p{N}_])clause\\s+([A-Z]?\\d+(?:\\.\\d+)*)', 1) AS cl,
  regexp_extract_all(t, '(?:^|[^\\p{L}\\p{N}_])((?:ISO/IEC|IEC|ISO|CISPR|EN)\\s+\\d+(?:-\\d+)*)', 1) AS sd FROM docs)"""

_SQL_LEVELS = """
        SELECT l.document_id, l.clause_id AS chunk_id, level, sha256(content_text) AS text_hash,
          length(content_text) AS content_length,
          EXISTS (SELECT 1 FROM reqs r WHERE r.document_id = l.document_id AND r.clause_id = l.clause_id) AS has_requirements,
          EXISTS (SELECT 1 FROM tabs r WHERE r.document_id = l.document_id AND r.clause_id = l.clause_id) AS has_tables,
          EXISTS (SELECT 1 FROM figs r WHERE r.document_id = l.document_id AND r.clause_id = l.clause_id) AS has_figures
        FROM levels l"""

SQL = {
    "strip_html": f"SELECT page_id, {fx.sql_strip_html('html')} AS text FROM pages",
    "classify_header": fx.with_ctes(_P, f"""
        SELECT document_id, pos, kind, CASE WHEN kind <> 'text' THEN first_word END AS id,
          CASE kind WHEN 'full' THEN {fx.sql_strip('text[length(first_word)+1:]')} WHEN 'text' THEN text END AS title
        FROM heads WHERE kind IS NOT NULL"""),
    "open_clauses": fx.with_ctes(_P, """
        SELECT document_id, pos, opened_id AS clause_id, opened_title AS title FROM openings"""),
    "assign_clause": fx.with_ctes(_P, "SELECT document_id, pos, block_type, clause_id FROM assigned"),
    "pair_captions": fx.with_ctes(_P, """
        SELECT document_id, pos, block_type, clause_id, caption_text AS caption FROM assigned
        WHERE block_type IN ('Table', 'Picture')"""),
    "extract_tables": fx.with_ctes(_P, """
        SELECT document_id, clause_id, pos, html, number, caption,
          CAST(to_json([[l, 'x'], [CAST(c AS VARCHAR)]]) AS VARCHAR) AS rows FROM tabs"""),
    "extract_figures": fx.with_ctes(_P, """
        SELECT document_id, clause_id, pos, number, path, format, original_key, size_bytes, caption FROM figs"""),
    "content_blocks": fx.with_ctes(_P, "SELECT document_id, clause_id, pos, type, text FROM content"),
    "extract_requirements": fx.with_ctes(_P, "SELECT document_id, clause_id, pos, type, keyword, text FROM reqs"),
    "requirements_by_type": fx.with_ctes(_P, """
        SELECT document_id, count(*) FILTER (type = 'prohibition') AS prohibition,
          count(*) FILTER (type = 'mandatory') AS mandatory, count(*) FILTER (type = 'recommendation') AS recommendation,
          count(*) FILTER (type = 'permission') AS permission FROM reqs GROUP BY document_id"""),
    "caption_number": fx.with_ctes(fx.SQL_BLOCKS, f"""
        SELECT document_id, pos, {fx.sql_table_number('html')} AS table_number,
          {fx.sql_figure_number('html')} AS figure_number FROM blocks WHERE block_type = 'Caption'"""),
    "clause_dim": fx.with_ctes(_P, "SELECT document_id, clause_id, title, first_pos FROM clauses"),
    "clause_tree": fx.with_ctes(_P, "SELECT document_id, clause_id, tree_parent_id FROM tree"),
    "root_clauses": fx.with_ctes(_P, """
        SELECT document_id, clause_id, title FROM clauses c WHERE NOT EXISTS (SELECT 1 FROM wanted w JOIN clauses p
          ON w.document_id = p.document_id AND w.w = p.clause_id
          WHERE w.document_id = c.document_id AND w.clause_id = c.clause_id)"""),
    "order_roots": fx.with_ctes(fx.numbers_end(_P), """
        SELECT document_id, clause_id, CASE WHEN regexp_matches(clause_id, '^\\d') THEN
          '0|' || array_to_string(list_transform(string_split(clause_id, '.'), lambda x: lpad(x, 20, '0')), '.')
          ELSE '1|' || clause_id END AS sort_key FROM tree WHERE tree_parent_id IS NULL"""),
    "document_statistics": fx.with_ctes(_P, "SELECT * FROM stats"),
    "misc_images": fx.with_ctes(_P, """
        SELECT document_id, number, 'output_images/' || document_id || '/misc/misc_' || number || '_page_' || pos
          || '_picture_0.' || format AS path, caption, format, original_key, size_bytes FROM (
          SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY pos) AS number FROM imgs WHERE clause_id IS NULL)"""),
    "make_chunks": fx.with_ctes(_P, """
        SELECT c.document_id, c.clause_id AS chunk_id, c.title,
          nullif(regexp_extract(c.clause_id, '^(.*)\\.[^.]*$', 1), '') AS parent_id,
          coalesce(x.types, '') AS content_types, sha256(coalesce(x.texts, '')) AS content_hash,
          coalesce(t.numbers, '') AS table_numbers, coalesce(f.numbers, '') AS figure_numbers,
          coalesce(f.paths, '') AS figure_paths, coalesce(r.keywords, '') AS keywords,
          coalesce(k.kids, '') AS children_ids
        FROM clauses c
        LEFT JOIN (SELECT document_id, clause_id, string_agg(type, '|' ORDER BY pos) AS types,
          string_agg(text, '|' ORDER BY pos) AS texts FROM content GROUP BY ALL) x USING (document_id, clause_id)
        LEFT JOIN (SELECT document_id, clause_id, string_agg(coalesce(number, '-'), '|' ORDER BY pos) AS numbers
          FROM tabs GROUP BY ALL) t USING (document_id, clause_id)
        LEFT JOIN (SELECT document_id, clause_id, string_agg(number, '|' ORDER BY pos) AS numbers,
          string_agg(path, '|' ORDER BY pos) AS paths FROM figs GROUP BY ALL) f USING (document_id, clause_id)
        LEFT JOIN (SELECT document_id, clause_id, string_agg(keyword, '|' ORDER BY pos) AS keywords
          FROM reqs GROUP BY ALL) r USING (document_id, clause_id)
        LEFT JOIN (SELECT document_id, tree_parent_id AS clause_id, string_agg(tree.clause_id, '|' ORDER BY first_pos) AS kids
          FROM tree WHERE tree_parent_id IS NOT NULL GROUP BY ALL) k USING (document_id, clause_id)"""),
    "chunk_levels_long": fx.with_ctes(_ONE, _SQL_LEVELS),
    "chunk_levels": fx.with_ctes(_P, _SQL_LEVELS),
    "dedup_references": fx.with_ctes(fx.SQL_BLOCKS + "," + _LISTED, """
        SELECT document_id, sum(len(cl)) AS clauses_listed, sum(len(sd)) AS standards_listed,
          sum(len(list_distinct(cl))) AS clauses_kept, sum(len(list_distinct(sd))) AS standards_kept
        FROM found GROUP BY document_id"""),
    "extract_references": fx.with_ctes(_P, """
        SELECT DISTINCT document_id, clause_id, pos, reference_type, target FROM (
          SELECT document_id, clause_id, pos, 'clause' AS reference_type, unnest(regexp_extract_all(text, '(?i)(?:^|[^\\p{L}\\p{N}_])clause\\s+([A-Z]?\\d+(?:\\.\\d+)*)', 1)) AS target FROM content
          UNION ALL SELECT document_id, clause_id, pos, 'table', unnest(regexp_extract_all(text, '(?i)(?:^|[^\\p{L}\\p{N}_])table\\s+([A-Z]?\\d+(?:\\.\\d+)*)', 1)) FROM content
          UNION ALL SELECT document_id, clause_id, pos, 'figure', unnest(regexp_extract_all(text, '(?i)(?:^|[^\\p{L}\\p{N}_])(?:figure|fig\\.?)\\s+([A-Z]?\\d+(?:\\.\\d+)*)', 1)) FROM content
          UNION ALL SELECT document_id, clause_id, pos, 'standard', unnest(regexp_extract_all(text, '(?:^|[^\\p{L}\\p{N}_])((?:ISO/IEC|IEC|ISO|CISPR|EN)\\s+\\d+(?:-\\d+)*)', 1)) FROM content)"""),
    "assign_long_document": fx.with_ctes(_ONE, "SELECT pos, clause_id, opened_title, caption_text FROM assigned"),
    "make_chunks_long_document": fx.with_ctes(_ONE, """
        SELECT clause_id AS chunk_id, title,
          (SELECT count(*) FROM content x WHERE x.clause_id = c.clause_id) AS n_content,
          (SELECT count(*) FROM tabs x WHERE x.clause_id = c.clause_id) AS n_tables,
          (SELECT count(*) FROM reqs x WHERE x.clause_id = c.clause_id) AS n_requirements,
          (SELECT count(*) FROM tree x WHERE x.tree_parent_id = c.clause_id) AS n_children,
          (SELECT count(*) FROM figs x WHERE x.clause_id = c.clause_id) AS n_figures,
          (SELECT count(*) FROM figs x WHERE x.clause_id = c.clause_id) AS last_figure FROM clauses c"""),
    "structure_basic": fx.with_ctes(_P, f"""
        , b_flag AS (SELECT h.*, o.opened_id,
            CASE WHEN o.opened_id IS NOT NULL THEN 'clear' WHEN block_type = 'Caption' AND text <> '' THEN 'set'
              WHEN block_type = 'Table' AND html <> '' THEN 'clear' WHEN block_type = 'Picture' THEN 'clear' END AS ev
          FROM heads h LEFT JOIN openings o ON h.document_id = o.document_id AND h.pos = o.pos),
        b_carried AS (SELECT *,
          last_value(opened_id IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS clause_id,
          last_value(CASE ev WHEN 'set' THEN 's' || text WHEN 'clear' THEN 'c' END IGNORE NULLS)
            OVER (PARTITION BY document_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS waiting FROM b_flag),
        b AS (SELECT *, coalesce(CASE WHEN waiting[1] = 's' THEN waiting[2:] END, nullif({fx.sql_strip_html('caption')}, '')) AS cap
          FROM b_carried WHERE clause_id IS NOT NULL),
        b_figs AS (SELECT document_id, clause_id, pos, cap, doc_id,
          row_number() OVER (PARTITION BY document_id, clause_id ORDER BY pos) AS n FROM b WHERE has_image)
        SELECT c.document_id, c.clause_id AS chunk_id,
          (SELECT count(*) FROM b WHERE b.document_id = c.document_id AND b.clause_id = c.clause_id AND block_type = 'Text' AND text <> '') AS n_content,
          coalesce((SELECT string_agg(coalesce(cap, '-'), '|' ORDER BY pos) FROM b WHERE b.document_id = c.document_id AND b.clause_id = c.clause_id
             AND block_type = 'Table' AND html <> ''), '') AS captions,
          coalesce((SELECT string_agg('output_images/' || f.document_id || '/' || replace(f.clause_id, '.', '_') || '/figure_' || n ||
             CASE WHEN doc_id % 2 = 0 THEN '.png' ELSE '.jpg' END, '|' ORDER BY pos) FROM b_figs f
             WHERE f.document_id = c.document_id AND f.clause_id = c.clause_id), '') AS paths,
          coalesce((SELECT string_agg(coalesce(cap, '-'), '|' ORDER BY pos) FROM b_figs f
             WHERE f.document_id = c.document_id AND f.clause_id = c.clause_id), '') AS figure_captions,
          (SELECT count(*) FROM b WHERE b.document_id = c.document_id AND b.clause_id = c.clause_id AND block_type = 'Text'
             AND regexp_matches(text, '(?i){fx._W}(shall not|shall|should|may)(?:$|[^\\p{{L}}\\p{{N}}_])')) AS n_requirements
        FROM clauses c"""),
}
