"""Layout blocks made from the ``documents`` and ``pages`` tables, in Spark and in SQL.

The prose has no clause numbers, captions or normative words, so marks are added by arithmetic on
(doc_id, pos). Whole texts are used: a header that is a number alone leaves its line to the next header.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.plans.stage import stage

# One mark per position; {c} is the running section, l the line.
_MARKED = """
SELECT concat('doc', doc_id) AS document_id, pos, doc_id, l, prior, pos = n - 1 AS ends, (pos + doc_id) % 13 AS k,
       CAST(1 + floor(pos / 13) AS INT) AS c,
       CASE WHEN doc_id % 5 = 0 THEN 'A.' ELSE '' END AS annex
"""

_BLOCKS = """
SELECT document_id, pos,
  CASE k WHEN 0 THEN 'SectionHeader' WHEN 1 THEN 'Text' WHEN 2 THEN 'Caption'
    WHEN 3 THEN (CASE WHEN doc_id % 4 = 0 THEN 'ListItem' ELSE 'SectionHeader' END)
    WHEN 4 THEN 'SectionHeader' WHEN 5 THEN 'Table' WHEN 6 THEN 'ListItem' WHEN 7 THEN 'Caption'
    WHEN 8 THEN 'SectionHeader' WHEN 9 THEN 'Picture' WHEN 10 THEN 'Footnote' WHEN 11 THEN 'Text'
    ELSE 'Text' END AS block_type,
  CASE k WHEN 0 THEN concat('<h2>', CASE WHEN doc_id % 5 = 0 THEN 'A' ELSE CAST(c AS {S}) END, ' ', l, '</h2>')
    WHEN 1 THEN concat('<p>', l, ' shall be so</p>')
    WHEN 2 THEN concat('Table ', CAST(c AS {S}), '.', CAST(pos AS {S}), ' - ', l)
    WHEN 3 THEN concat(annex, CAST(c AS {S}), '.1', CASE WHEN doc_id % 4 = 0 OR ends THEN concat(' ', l) ELSE '' END)
    WHEN 4 THEN concat('<b>Part</b> ', CASE WHEN doc_id % 4 <> 0 AND pos > 0 THEN concat(prior, ' ') ELSE '' END, l)
    WHEN 5 THEN (CASE WHEN doc_id % 6 = 0 THEN '' ELSE concat('<table><tr><td>', l, '</td></tr></table>') END)
    WHEN 6 THEN concat('<li>', l, ' should see clause ', CAST(c AS {S}), '.1 and IEC 61000-4-', CAST(doc_id % 7 AS {S}), '</li>')
    WHEN 7 THEN (CASE WHEN doc_id % 2 = 0 THEN concat('Figure ', CAST(c AS {S}), ' ', l) ELSE l END)
    WHEN 8 THEN concat(annex, CAST(c AS {S}), '.1.', CAST(1 + pos % 3 AS {S}), ' ', l)
    WHEN 10 THEN concat(l, ' may')
    WHEN 12 THEN (CASE WHEN doc_id % 2 = 1 THEN concat(l, ' shall not') ELSE l END)
    ELSE l END AS html,
  CASE WHEN k = 5 AND doc_id % 3 = 0 THEN '<i>Table 9</i>' WHEN k = 9 AND doc_id % 3 = 1 THEN concat('Fig. A', CAST(c AS {S})) END AS caption,
  k, c, l, doc_id
"""


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def spread_small(df: DataFrame) -> DataFrame:
    """A table with fewer splits than there are cores is spread before costly per-row work."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def marked_lines(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread_small(read(spark, sf, "documents").select("doc_id", "text"))
    parts = docs.select("doc_id", F.split("text", r"\n|\. ").alias("parts"))
    lines = parts.selectExpr("doc_id", "size(parts) AS n", "posexplode(transform(parts, (x, i) -> struct(x AS l, CASE WHEN i > 0 THEN parts[i - 1] END AS prior))) AS (p, x)")
    return lines.selectExpr("doc_id", "CAST(p AS BIGINT) AS pos", "x.l AS l", "x.prior AS prior", "n")


#: What ends a text may be a number alone as well, its line a block of its own after it. Nothing follows that could be its title.
_AT_END = ("doc_id % 4 = 0 OR ends THEN", "doc_id % 4 = 0 THEN")
_LINE_AT_END = "pos + 1 AS pos, 'Text' AS block_type, l AS html, CAST(NULL AS {S}) AS caption"
_ENDS_IN_NUMBER = "k = 3 AND ends AND doc_id % 4 <> 0"


def document_blocks(spark: SparkSession, sf: str, numbers_end: bool = False) -> DataFrame:
    """``documents`` as a stored table of layout blocks, as an extractor would leave it. With ``numbers_end`` a text may end in a
    number alone."""
    marked = marked_lines(spark, sf).selectExpr(
        "concat('doc', doc_id) AS document_id", "pos", "doc_id", "l", "prior", "pos = n - 1 AS ends", "(pos + doc_id) % 13 AS k",
        "CAST(1 + floor(pos / 13) AS INT) AS c", "CASE WHEN doc_id % 5 = 0 THEN 'A.' ELSE '' END AS annex",
    )
    picture = (
        "map(concat('/page/', pos, '/Picture/0'),"
        " base64(concat(CASE WHEN doc_id % 2 = 0 THEN X'89504E47' ELSE X'FFD8FF' END, encode(l, 'UTF-8'))),"
        " concat('/page/', pos, '/Picture/1'), '!!')"
    )
    body = _BLOCKS.replace("{S}", "STRING").strip().removeprefix("SELECT")
    more = ""
    if numbers_end:
        body, line = body.replace(*_AT_END), _LINE_AT_END.replace("{S}", "STRING")
        more = f" UNION ALL SELECT document_id, {line}, NULL, NULL FROM {{marked}} WHERE {_ENDS_IN_NUMBER}"
    blocks = spark.sql(
        f"""SELECT document_id, pos, block_type, html, caption,
              CASE WHEN k = 5 THEN array(array(l, 'x'), array(CAST(c AS STRING))) END AS rows,
              CASE WHEN k = 9 AND doc_id % 8 <> 7 THEN {picture} END AS images
            FROM (SELECT {body} FROM {{marked}}){more}""",
        marked=marked,
    )
    return stage(blocks, "layout-blocks")


def _sql_blocks(numbers_end: bool = False) -> str:
    body, more = _BLOCKS.replace("{S}", "VARCHAR").strip(), ""
    if numbers_end:
        body, line = body.replace(*_AT_END), _LINE_AT_END.replace("{S}", "VARCHAR")
        more = f" UNION ALL SELECT document_id, {line}, 11 AS k, c, l, doc_id, false FROM marked WHERE {_ENDS_IN_NUMBER}"
    return f"""
lines AS (SELECT doc_id, unnest(parts) AS l, unnest(range(len(parts))) AS pos, unnest([NULL] || parts[:-2]) AS prior, len(parts) AS n
          FROM (SELECT doc_id, regexp_split_to_array(text, '\\n|\\. ') AS parts FROM documents)),
marked AS ({_MARKED.strip()} FROM lines),
blocks AS ({body}, k = 9 AND doc_id % 8 <> 7 AS has_image FROM marked{more})"""


#: CTEs ``lines``, ``marked`` and ``blocks``: the twin of :func:`document_blocks`.
SQL_BLOCKS = _sql_blocks()


def numbers_end(ctes: str) -> str:
    """CTEs over blocks of which some texts end in a number alone."""
    return ctes.replace(SQL_BLOCKS, _sql_blocks(True))


_W = "(?:^|[^\\p{L}\\p{N}_])"
_TRIM = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"


def sql_strip(expr: str) -> str:
    return f"trim({expr}, {_TRIM})"


def sql_strip_html(expr: str) -> str:
    return sql_strip(f"regexp_replace(coalesce({expr}, ''), '<[^>]+>', '', 'g')")


def sql_table_number(expr: str) -> str:
    return f"nullif(regexp_extract({expr}, '(?i){_W}table\\s+([A-Z]?\\d+(?:\\.\\d+)*)', 1), '')"


def sql_figure_number(expr: str) -> str:
    return f"nullif(regexp_extract({expr}, '(?i){_W}(?:figure|fig\\.?)\\s+([A-Z]?\\d+(?:\\.\\d+)*)', 1), '')"


#: CTEs down to ``assigned``: plain windows over whole documents, written independently of the Spark plan.
SQL_ASSIGNED = (
    SQL_BLOCKS
    + f""",
texts AS (SELECT *, CASE WHEN block_type = 'Table' THEN '' ELSE {sql_strip_html('html')} END AS text FROM blocks),
heads AS (SELECT *,
   CASE WHEN block_type <> 'SectionHeader' OR text = '' THEN NULL
        WHEN regexp_matches(text, '(?i)^([A-Z]|\\d+)(?:\\.(\\d+))*\\s+(.+)$') THEN 'full'
        WHEN regexp_matches(text, '(?i)^([A-Z]|\\d+)(?:\\.(\\d+))*\\s*$') THEN 'num' ELSE 'text' END AS kind,
   regexp_extract(text, '^(\\S+)', 1) AS first_word,
   {sql_table_number('text')} AS cap_table, {sql_figure_number('text')} AS cap_figure FROM texts),
header_rows AS (SELECT *, lag(kind) OVER d AS prev_kind, lag(first_word) OVER d AS prev_id FROM heads
   WHERE kind IS NOT NULL WINDOW d AS (PARTITION BY document_id ORDER BY pos)),
openings AS (SELECT document_id, pos,
   CASE WHEN kind = 'full' THEN first_word ELSE prev_id END AS opened_id,
   CASE WHEN kind = 'full' THEN {sql_strip("text[length(first_word)+1:]")} ELSE text END AS opened_title
   FROM header_rows WHERE kind = 'full' OR (kind = 'text' AND prev_kind = 'num')),
flagged AS (SELECT h.*, o.opened_id, o.opened_title,
   CASE WHEN o.opened_id IS NOT NULL THEN 'clear'
        WHEN h.block_type = 'Caption' AND coalesce(cap_table, cap_figure) IS NOT NULL THEN 'set'
        WHEN h.block_type = 'Table' AND h.html <> '' THEN 'clear'
        WHEN h.has_image THEN 'clear' END AS ev
   FROM heads h LEFT JOIN openings o ON h.document_id = o.document_id AND h.pos = o.pos),
carried AS (SELECT *,
   last_value(opened_id IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS clause_id,
   last_value(CASE ev WHEN 'set' THEN 's' || text WHEN 'clear' THEN 'c' END IGNORE NULLS)
      OVER (PARTITION BY document_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS waiting FROM flagged),
assigned AS (SELECT *, CASE WHEN block_type IN ('Table', 'Picture') THEN
   coalesce(CASE WHEN waiting[1] = 's' THEN waiting[2:] END, nullif({sql_strip_html('caption')}, '')) END AS caption_text
   FROM carried)"""
)

#: CTEs for what is cut out of ``assigned``.
SQL_PARTS = (
    SQL_ASSIGNED
    + f""",
content AS (SELECT document_id, clause_id, pos, text,
   CASE block_type WHEN 'Text' THEN 'paragraph' WHEN 'ListItem' THEN 'list_item' WHEN 'Footnote' THEN 'footnote' ELSE 'caption' END AS type
   FROM assigned WHERE clause_id IS NOT NULL AND text <> '' AND (block_type IN ('Text', 'ListItem', 'Footnote')
     OR (block_type = 'Caption' AND cap_table IS NULL AND cap_figure IS NULL))),
reqs AS (SELECT *, CASE keyword WHEN 'shall not' THEN 'prohibition' WHEN 'shall' THEN 'mandatory'
     WHEN 'should' THEN 'recommendation' ELSE 'permission' END AS type FROM (
   SELECT document_id, clause_id, pos, text,
     lower(regexp_extract(text, '(?i){_W}(shall not|shall|should|may)(?:$|[^\\p{{L}}\\p{{N}}_])', 1)) AS keyword
   FROM assigned WHERE clause_id IS NOT NULL AND block_type IN ('Text', 'ListItem')) WHERE keyword <> ''),
tabs AS (SELECT document_id, clause_id, pos, html, {sql_table_number('caption_text')} AS number, caption_text AS caption, l, c
   FROM assigned WHERE block_type = 'Table' AND html <> '' AND clause_id IS NOT NULL),
imgs AS (SELECT document_id, clause_id, pos, '/page/' || pos || '/Picture/0' AS original_key,
   CASE WHEN doc_id % 2 = 0 THEN 'png' ELSE 'jpg' END AS format,
   (CASE WHEN doc_id % 2 = 0 THEN 4 ELSE 3 END) + strlen(l) AS size_bytes, caption_text AS caption
   FROM assigned WHERE has_image),
figs AS (SELECT *, coalesce({sql_figure_number('caption')}, CAST(n AS VARCHAR)) AS number,
   'output_images/' || document_id || '/' || replace(clause_id, '.', '_') || '/figure_' || n || '_page_' || pos || '_picture_0.' || format AS path
   FROM (SELECT *, row_number() OVER (PARTITION BY document_id, clause_id ORDER BY pos) AS n FROM imgs WHERE clause_id IS NOT NULL)),
clauses AS (SELECT document_id, opened_id AS clause_id, arg_min(opened_title, pos) AS title, min(pos) AS first_pos
   FROM assigned WHERE opened_id IS NOT NULL GROUP BY ALL),
wanted AS (SELECT *, CASE WHEN regexp_matches(clause_id, '^\\d') THEN nullif(regexp_extract(clause_id, '^(.*)\\.[^.]*$', 1), '')
   WHEN contains(clause_id, '.') THEN split_part(clause_id, '.', 1) END AS w FROM clauses),
tree AS (SELECT w.document_id, w.clause_id, w.title, w.first_pos, p.clause_id AS tree_parent_id
   FROM wanted w LEFT JOIN clauses p ON w.document_id = p.document_id AND w.w = p.clause_id),
stats AS (SELECT document_id, count(*) FILTER (has_image) AS total_images,
   count(*) FILTER (has_image AND clause_id IS NOT NULL) AS images_in_clauses,
   count(*) FILTER (has_image AND clause_id IS NULL) AS images_in_misc,
   count(*) FILTER (block_type = 'Table' AND html <> '') AS total_tables,
   count(DISTINCT opened_id) AS total_clauses FROM assigned GROUP BY document_id),
levels AS (SELECT c.document_id, c.clause_id, c.title,
   nullif(regexp_extract(c.clause_id, '^(.*)\\.[^.]*$', 1), '') AS parent_id,
   len(string_split(c.clause_id, '.')) AS level,
   coalesce((SELECT string_agg(text, ' ' ORDER BY pos) FROM content x WHERE x.document_id = c.document_id AND x.clause_id = c.clause_id), '') AS content_text
   FROM clauses c)"""
)


def with_ctes(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()}\n{select.strip()}"
