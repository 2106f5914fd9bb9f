"""Text expressions as Spark SQL, to be used in ``selectExpr`` and ``expr``.

All of them are built-in functions, so Catalyst sees everything; one string per expression also keeps
plan building short.
"""

from __future__ import annotations

# Patterns of the clause numbering, captions and normative words.
CLAUSE_WITH_TITLE = r"(?id)^([A-Z]|\d+)(?:\.(\d+))*\s+(.+)$"
CLAUSE_NUMBER_ONLY = r"(?id)^([A-Z]|\d+)(?:\.(\d+))*\s*$"
HTML_TAG = r"<[^>]+>"
TABLE_NUMBER = r"(?i)(?<![\p{L}\p{N}_])table\s+([A-Z]?\d+(?:\.\d+)*)"
FIGURE_NUMBER = r"(?i)(?<![\p{L}\p{N}_])(?:figure|fig\.?)\s+([A-Z]?\d+(?:\.\d+)*)"
NORMATIVE_WORDS = {
    "shall not": "prohibition",
    "shall": "mandatory",
    "should": "recommendation",
    "may": "permission",
}

# Our own patterns for mentions inside running text.
CLAUSE_MENTION = r"(?i)(?<![\p{L}\p{N}_])clause\s+([A-Z]?\d+(?:\.\d+)*)"
STANDARD_MENTION = r"(?<![\p{L}\p{N}_])((?:ISO/IEC|IEC|ISO|CISPR|EN)\s+\d+(?:-\d+)*)"
MENTIONS = {
    "clauses": CLAUSE_MENTION,
    "tables": TABLE_NUMBER,
    "figures": FIGURE_NUMBER,
    "standards": STANDARD_MENTION,
}


def quote(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strip(x: str) -> str:
    return rf"btrim({x}, ' \t\n\r\u000c\u000b')"


def strip_html(x: str) -> str:
    """Text without tags, trimmed; null gives an empty string."""
    return strip(f"regexp_replace(coalesce({x}, ''), {quote(HTML_TAG)}, '')")


def header_kind(text: str) -> str:
    """``full`` (id and title), ``num`` (id only) or ``text`` of a section header; null for empty text."""
    return (
        f"CASE WHEN coalesce({text}, '') = '' THEN NULL"
        f" WHEN regexp_like({text}, {quote(CLAUSE_WITH_TITLE)}) THEN 'full'"
        f" WHEN regexp_like({text}, {quote(CLAUSE_NUMBER_ONLY)}) THEN 'num' ELSE 'text' END"
    )


def header_struct(kind: str, text: str) -> str:
    """Kind, id and title of a header; null where the kind is null."""
    first = rf"regexp_extract({text}, r'^(\S+)', 1)"
    rest = strip(f"substring({text}, length({first}) + 1)")
    return (
        f"CASE WHEN {kind} IS NOT NULL THEN named_struct('kind', {kind},"
        f" 'id', CASE WHEN {kind} <> 'text' THEN {first} END,"
        f" 'title', CASE {kind} WHEN 'full' THEN {rest} WHEN 'text' THEN {text} END) END"
    )


def table_number(x: str) -> str:
    return f"nullif(regexp_extract({x}, {quote(TABLE_NUMBER)}, 1), '')"


def figure_number(x: str) -> str:
    return f"nullif(regexp_extract({x}, {quote(FIGURE_NUMBER)}, 1), '')"


def is_numbered_caption(x: str) -> str:
    return f"(regexp_like({x}, {quote(TABLE_NUMBER)}) OR regexp_like({x}, {quote(FIGURE_NUMBER)}))"


def first_word(x: str, words) -> str:
    """The first of the given words in a text, lower-cased, at Unicode word boundaries; else ''."""
    pattern = r"(?i)(?<![\p{L}\p{N}_])(" + "|".join(words) + r")(?![\p{L}\p{N}_])"
    return f"lower(regexp_extract({x}, {quote(pattern)}, 1))"


def lookup(x: str, table: dict[str, str]) -> str:
    cases = " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in table.items())
    return f"CASE {x} {cases} END"


def references_struct(text: str) -> str:
    """Clause, table, figure and standard mentions of a text, each list without repeats and in order."""
    fields = ", ".join(
        f"'{name}', array_distinct(regexp_extract_all({text}, {quote(p)}, 1))" for name, p in MENTIONS.items()
    )
    return f"named_struct({fields})"


def dedup_references(refs: str) -> str:
    """The same struct of lists with repeats removed and the order kept."""
    return "named_struct(" + ", ".join(f"'{name}', array_distinct({refs}.{name})" for name in MENTIONS) + ")"


def image_format(data: str) -> str:
    """Image format from the leading bytes, else ``bin``."""
    # Magic numbers.
    return (
        f"CASE WHEN startswith({data}, X'89504E47') THEN 'png' WHEN startswith({data}, X'FFD8FF') THEN 'jpg'"
        f" WHEN startswith({data}, X'47494638') THEN 'gif' WHEN startswith({data}, X'424D') THEN 'bmp'"
        f" WHEN startswith({data}, X'52494646') AND substring({data}, 9, 4) = X'57454250' THEN 'webp' ELSE 'bin' END"
    )


def parent_by_last_dot(clause_id: str) -> str:
    """The id without its last part, or null when there is no dot."""
    return rf"nullif(regexp_extract({clause_id}, r'^(.*)\.[^.]*$', 1), '')"


def clause_sort_key(clause_id: str) -> str:
    """Numeric ids by their integer parts, then all others by the string."""
    return (
        rf"CASE WHEN regexp_like({clause_id}, r'^\d') THEN concat('0|', array_join("
        rf"transform(split({clause_id}, r'\.'), p -> lpad(p, 20, '0')), '.')) ELSE concat('1|', {clause_id}) END"
    )


def joined_text(content: str, sep: str = " ") -> str:
    return f"array_join(transform({content}, c -> coalesce(c.text, '')), {quote(sep)})"
