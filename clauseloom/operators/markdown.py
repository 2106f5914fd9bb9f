"""Markdown reports -> blocks, table cells and inline runs. All of it is row-local."""

from __future__ import annotations

from pyspark.sql import DataFrame

from clauseloom.functions.text import quote, strip

# What a report leaves behind, and how its blocks and runs are marked.
CHAPTER_TAIL = r"(?is)---.*?(End of Chapter|Next:).*?---"
NOTE_LINE = r"(?id)> Note:.*?\n"
TABLE_OR_HEADING = r"(?md)(^\s*\|.*\|(?:\n\s*\|.*\|)*)|(^\s*#{1,6}\s+.*$)"
SEPARATOR_ROW = r"^\|?[\s\-:|]+\|?$"
INLINE = r"(?id)(\*\*.*?\*\*|<br\s*/?>|<sub>.*?</sub>)"
PAGE_BREAK = r"^-{3,}$"
_CUT = r"'\u0001'"


def clean_markdown(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, {quote(CHAPTER_TAIL)}, ''), {quote(NOTE_LINE)}, '')"


def _pieces(x: str, pattern: str) -> str:
    """The text cut before and after every match, matches kept, empty pieces dropped."""
    return (
        f"filter(split(regexp_replace({x}, {quote(pattern)}, concat({_CUT}, '$0', {_CUT})), {_CUT}), t -> t <> '')"
    )


def markdown_blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """Ordered blocks: ``table``, ``heading`` (level up to 9), ``page_break`` and one ``paragraph`` per line.

    A level-1 heading starts a new page, so a page break stands before it.
    """
    tokens = f"filter(transform({_pieces(text, TABLE_OR_HEADING)}, p -> {strip('p')}), p -> p <> '')"

    def block(kind: str, level: str, body: str) -> str:
        return f"struct('{kind}' AS kind, CAST({level} AS INT) AS level, {body} AS text)"

    page_break = block("page_break", "NULL", "''")
    title = strip("regexp_replace(token, '^#+', '')")
    blocks = (
        f"CASE WHEN startswith(token, '|') THEN array({block('table', 'NULL', 'token')})"
        f" WHEN startswith(token, '#') THEN array_compact(array(CASE WHEN marks = 1 THEN {page_break} END,"
        f" CASE WHEN title <> '' THEN {block('heading', 'least(marks, 9)', 'title')} END))"
        f" WHEN regexp_like(token, {quote(PAGE_BREAK)}) THEN array({page_break})"
        f" ELSE transform(filter(split(token, '\\n'), x -> {strip('x')} <> ''), x -> {block('paragraph', 'NULL', 'x')}) END"
    )
    return (
        df.selectExpr(key, f"posexplode({tokens}) AS (token_no, token)")
        .selectExpr("*", "length(regexp_extract(token, '^#+', 0)) AS marks", f"{title} AS title")
        .selectExpr(key, "token_no", f"posexplode({blocks}) AS (line_no, b)")
        .select(key, "token_no", "line_no", "b.kind", "b.level", "b.text")
    )


def markdown_table_cells(blocks: DataFrame, key: str) -> DataFrame:
    """Cells of the table blocks; separator rows and cells beyond the widest row's pipes are dropped."""
    rows = (
        f"filter(transform(split(text, '\\n'), r -> {strip('r')}),"
        f" r -> r <> '' AND NOT regexp_like(r, {quote(SEPARATOR_ROW)}))"
    )
    return (
        blocks.filter("kind = 'table'")
        .selectExpr(key, "token_no", f"{rows} AS rows")
        .selectExpr("*", "array_max(transform(rows, r -> length(r) - length(replace(r, '|', '')))) - 1 AS columns")
        .filter("columns > 0")
        .selectExpr(key, "token_no", "columns", "posexplode(rows) AS (row_no, row)")
        .selectExpr(key, "token_no", "columns", "row_no", r"posexplode(split(btrim(row, '|'), r'\|')) AS (col_no, cell)")
        .filter("col_no < columns")
        .selectExpr(key, "token_no", "row_no", "col_no", f"{strip('cell')} AS cell")
    )


def inline_runs(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Bold, subscript, line-break and plain runs of a line, in order."""
    kind = (
        "CASE WHEN startswith(run, '**') AND endswith(run, '**') AND length(run) >= 4 THEN 'bold'"
        " WHEN startswith(lower(run), '<sub>') AND endswith(lower(run), '</sub>') THEN 'subscript'"
        r" WHEN regexp_like(run, r'(?i)^<br\s*/?>') THEN 'line_break' ELSE 'plain' END"
    )
    inner = (
        "CASE kind WHEN 'bold' THEN substring(run, 3, length(run) - 4)"
        " WHEN 'subscript' THEN substring(run, 6, length(run) - 11) WHEN 'line_break' THEN '' ELSE run END"
    )
    return (
        df.selectExpr(*keys, f"posexplode({_pieces(text, INLINE)}) AS (run_no, run)")
        .selectExpr("*", f"{kind} AS kind")
        .selectExpr(*keys, "run_no", "kind", f"{inner} AS text")
    )
