"""Layout blocks in document order -> clauses, content, tables, figures, requirements, chunks.

Which clause a block belongs to and which caption a table takes depend on what came before. All of it
is one pass: one shuffle by (document, segment) and windows over the same order. A document longer than
a segment gets one extra row at the start of each later segment, carrying the state so far. Whether there
is such a document is checked first; on a stored table the statistics of ``pos`` answer that without
reading. Callers that know pass ``long_documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.functions import text as tx
from clauseloom.plans.ordered import SEGMENT_ROWS, ordinal, segment_of
from clauseloom.plans.stage import stage

MODES = ("full", "basic")

_CLEARED = "named_struct('text', CAST(NULL AS STRING))"
_LOCAL = "PARTITION BY document_id, seg ORDER BY pos"
_PRIOR = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
_IS_TABLE = "block_type = 'Table' AND coalesce(html, '') <> ''"
# The clause a header opens: its own, or the number that waits for a title.
_OPENED = "CASE WHEN head.kind = 'full' THEN head.id WHEN head.kind = 'text' AND prev.kind = 'num' THEN prev.id END"
# Decoded images of a picture in their order; what cannot be decoded is left out.
_IMAGES = (
    "CASE WHEN block_type = 'Picture' THEN filter(transform("
    "filter(map_entries(images), e -> coalesce(e.value, '') <> ''),"
    " e -> named_struct('key', e.key, 'data', try_to_binary(e.value, 'base64'))), e -> e.data IS NOT NULL) END"
)
# What is needed of them where the bytes are not: the format is told by the first ones.
_HEADS_OF_IMAGES = (
    f"transform({_IMAGES}, e -> named_struct('key', e.key, 'data', substring(e.data, 1, 16), 'size_bytes', length(e.data)))"
)


def _basic(mode: str) -> bool:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    return mode == "basic"


def classify_blocks(blocks: DataFrame, mode: str = "full", segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Per-block facts that need no neighbours: clean text, header kind, caption event."""
    basic = _basic(mode)
    waits = "text <> ''" if basic else tx.is_numbered_caption("text")
    picture = "true" if basic else "coalesce(size(images), 0) > 0"
    return (
        blocks.selectExpr(
            "*",
            f"{segment_of('pos', segment_rows)} AS seg",
            f"CASE WHEN block_type = 'Table' THEN '' ELSE {tx.strip_html('html')} END AS text",
        )
        .selectExpr("*", f"CASE WHEN block_type = 'SectionHeader' THEN {tx.header_kind('text')} END AS kind")
        .selectExpr(
            "*",
            f"{tx.header_struct('kind', 'text')} AS head",
            f"CASE WHEN block_type = 'Caption' AND {waits} THEN named_struct('text', text)"
            f" WHEN ({_IS_TABLE}) OR (block_type = 'Picture' AND {picture}) THEN {_CLEARED} END AS event",
        )
        .drop("kind")
    )


def has_long_documents(blocks: DataFrame, segment_rows: int = SEGMENT_ROWS) -> bool:
    """Whether any document reaches past its first segment."""
    return not blocks.filter(f"pos >= {segment_rows}").isEmpty()


def _entry_states(b: DataFrame, segment_rows: int) -> DataFrame:
    """One row per later segment of a long document: last header, open clause, waiting caption."""
    segments = (
        b.filter(f"pos >= {segment_rows}")
        .selectExpr("document_id", f"{segment_of('pos', segment_rows)} AS seg")
        .distinct()
    )
    marker = f"seg * {segment_rows} - 1 AS pos"
    events = (
        b.filter("head IS NOT NULL OR event IS NOT NULL")
        .select("document_id", "seg", "pos", "head", "event")
        .join(segments.select("document_id").distinct(), "document_id", "left_semi")
    )
    rows = (
        events.unionByName(segments.selectExpr("*", marker), allowMissingColumns=True)
        .selectExpr("*", f"last(head, true) OVER ({_LOCAL} {_PRIOR}) AS prev")
        .selectExpr("* EXCEPT (event)", "event AS own_event", f"{_OPENED} AS opened")
        .selectExpr("*", f"CASE WHEN opened IS NOT NULL THEN {_CLEARED} ELSE own_event END AS event")
    )
    summary = rows.groupBy("document_id", "seg").agg(
        F.expr("max_by(head, pos) FILTER (WHERE head IS NOT NULL)").alias("last_head"),
        F.expr("max_by(opened, pos) FILTER (WHERE opened IS NOT NULL)").alias("last_open"),
        F.expr("max_by(event, pos) FILTER (WHERE event IS NOT NULL)").alias("last_event"),
        F.expr("max(pos) FILTER (WHERE event IS NOT NULL)").alias("event_pos"),
        # A title that comes first in its segment: only the earlier segments tell whether it opens a clause.
        F.expr("min(pos) FILTER (WHERE head.kind = 'text' AND prev IS NULL)").alias("unsure_pos"),
    )
    before = f"PARTITION BY document_id ORDER BY seg {_PRIOR}"
    return (
        summary.selectExpr("*", f"last(last_head, true) OVER ({before}) AS in_head")
        .selectExpr("*", "CASE WHEN unsure_pos IS NOT NULL AND in_head.kind = 'num' THEN in_head.id END AS late_open")
        .selectExpr(
            "document_id",
            "seg",
            "in_head",
            f"last(coalesce(last_open, late_open), true) OVER ({before}) AS in_open",
            "last(CASE WHEN late_open IS NOT NULL AND coalesce(event_pos, -1) < unsure_pos"
            f" THEN {_CLEARED} ELSE last_event END, true) OVER ({before}) AS in_event",
        )
        .filter("seg > 0")
        .selectExpr(
            "document_id", "seg", marker, "in_head AS head", "in_event AS event", "in_open AS entry_clause",
            "true AS is_entry",
        )
    )


def assign_blocks(
    blocks: DataFrame, mode: str = "full", segment_rows: int = SEGMENT_ROWS, long_documents: bool | None = None,
    lean: bool = False,
) -> DataFrame:
    """Every block with the clause it opens (``opened_id``, ``opened_title``), the clause it belongs to
    (``clause_id``) and, for tables and pictures, its caption (``caption_text``). ``lean`` is for what needs the HTML of
    tables alone and of an image, in ``imgs`` instead of ``images``, no more than its size and first bytes."""
    rows = classify_blocks(blocks, mode, segment_rows)
    if lean:
        rows = rows.selectExpr("* EXCEPT (html, images)", f"CASE WHEN {_IS_TABLE} THEN html END AS html", f"{_HEADS_OF_IMAGES} AS imgs")
    if has_long_documents(blocks, segment_rows) if long_documents is None else long_documents:
        rows = rows.unionByName(_entry_states(rows, segment_rows), allowMissingColumns=True)
    else:
        rows = rows.selectExpr("*", "CAST(NULL AS STRING) AS entry_clause", "CAST(NULL AS BOOLEAN) AS is_entry")
    return (
        rows.selectExpr("*", f"last(head, true) OVER ({_LOCAL} {_PRIOR}) AS prev")
        .selectExpr("*", f"CASE WHEN is_entry IS NULL THEN {_OPENED} END AS opened_id")
        .selectExpr(
            "*",
            f"last(coalesce(opened_id, entry_clause), true) OVER ({_LOCAL}"
            " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS clause_id",
            f"last(CASE WHEN opened_id IS NOT NULL THEN {_CLEARED} ELSE event END, true)"
            f" OVER ({_LOCAL} {_PRIOR}) AS waiting",
        )
        .filter("is_entry IS NULL")
        .selectExpr(
            "document_id", "pos", "seg", "block_type", "text", "html", "rows", "imgs" if lean else "images", "opened_id",
            "CASE WHEN opened_id IS NOT NULL THEN head.title END AS opened_title",
            "clause_id",
            "CASE WHEN block_type IN ('Table', 'Picture') THEN"
            f" coalesce(waiting.text, nullif({tx.strip_html('caption')}, '')) END AS caption_text",
        )
    )


def headers_only(blocks: DataFrame) -> DataFrame:
    """Which clauses open depends on the section headers alone."""
    return blocks.filter("block_type = 'SectionHeader'")


def classify_headers(blocks: DataFrame) -> DataFrame:
    """Non-empty section headers with kind, id and title."""
    heads = classify_blocks(headers_only(blocks)).filter("head IS NOT NULL")
    return heads.select("document_id", "pos", "head.kind", "head.id", "head.title")


def open_clauses(assigned: DataFrame) -> DataFrame:
    """The headers that open a clause."""
    return assigned.filter("opened_id IS NOT NULL").selectExpr(
        "document_id", "pos", "opened_id AS clause_id", "opened_title AS title"
    )


def pair_captions(assigned: DataFrame) -> DataFrame:
    """Tables and pictures with the caption they take."""
    return assigned.filter("block_type IN ('Table', 'Picture')").selectExpr(
        "document_id", "pos", "block_type", "clause_id", "caption_text AS caption"
    )


def _content_type(mode: str) -> str:
    more = "" if _basic(mode) else (
        " WHEN block_type = 'ListItem' THEN 'list_item' WHEN block_type = 'Footnote' THEN 'footnote'"
        f" WHEN block_type = 'Caption' AND NOT {tx.is_numbered_caption('text')} THEN 'caption'"
    )
    return f"CASE WHEN text = '' OR clause_id IS NULL THEN NULL WHEN block_type = 'Text' THEN 'paragraph'{more} END"


def _keyword(mode: str, words: dict[str, str]) -> str:
    kinds = "('Text')" if _basic(mode) else "('Text', 'ListItem')"
    return (
        f"CASE WHEN block_type IN {kinds} AND clause_id IS NOT NULL"
        f" THEN nullif({tx.first_word('text', words)}, '') END"
    )


def _table_number(mode: str) -> str:
    return "CAST(NULL AS STRING)" if _basic(mode) else tx.table_number("caption_text")


def _figure_number(mode: str) -> str:
    return "CAST(NULL AS STRING)" if _basic(mode) else tx.figure_number("caption_text")


def _format(mode: str, data: str) -> str:
    fmt = tx.image_format(data)
    return f"CASE WHEN {fmt} IN ('bmp', 'webp') THEN 'bin' ELSE {fmt} END" if _basic(mode) else fmt


def _image_ref(key: str) -> str:
    return f"lower(btrim(replace({key}, '/', '_'), '_'))"


def _figure_path(mode: str, clause: str, n: str, key: str, fmt: str) -> str:
    ref = "" if _basic(mode) else f", '_', {_image_ref(key)}"
    return f"concat('output_images/', document_id, '/', replace({clause}, '.', '_'), '/figure_', {n}{ref}, '.', {fmt})"


def content_blocks(assigned: DataFrame, mode: str = "full") -> DataFrame:
    """Paragraphs, list items, footnotes and plain captions that belong to a clause."""
    typed = assigned.selectExpr("document_id", "clause_id", "pos", f"{_content_type(mode)} AS type", "text")
    return typed.filter("type IS NOT NULL")


def extract_requirements(
    assigned: DataFrame, words: dict[str, str] = tx.NORMATIVE_WORDS, mode: str = "full"
) -> DataFrame:
    """At most one requirement per block, by the first normative word."""
    found = assigned.selectExpr("document_id", "clause_id", "pos", f"{_keyword(mode, words)} AS keyword", "text")
    return found.filter("keyword IS NOT NULL").selectExpr("*", f"{tx.lookup('keyword', words)} AS type")


def extract_tables(assigned: DataFrame, mode: str = "full") -> DataFrame:
    """Tables inside a clause."""
    return assigned.filter(f"{_IS_TABLE} AND clause_id IS NOT NULL").selectExpr(
        "document_id", "clause_id", "pos", "html", f"{_table_number(mode)} AS number", "caption_text AS caption",
        "rows",
    )


def _exploded_images(assigned: DataFrame) -> DataFrame:
    return assigned.filter("block_type = 'Picture'").selectExpr(
        "document_id", "clause_id", "pos", "seg", "caption_text", f"posexplode({_IMAGES}) AS (img_no, img)"
    )


def extract_figures(assigned: DataFrame, mode: str = "full", keep_data: bool = False) -> DataFrame:
    """Decoded images inside a clause, numbered by their caption or by a running count in the clause."""
    images = _exploded_images(assigned).filter("clause_id IS NOT NULL")
    out = (
        ordinal(images, ["document_id", "clause_id"], ["seg"], ["pos", "img_no"], "n")
        .selectExpr("*", f"{_format(mode, 'img.data')} AS format")
        .selectExpr(
            "document_id", "clause_id", "pos", "img_no",
            f"coalesce({_figure_number(mode)}, CAST(n AS STRING)) AS number",
            f"{_figure_path(mode, 'clause_id', 'n', 'img.key', 'format')} AS path",
            "format", "img.key AS original_key", "length(img.data) AS size_bytes", "caption_text AS caption",
            "img.data AS data",
        )
    )
    return out if keep_data else out.drop("data")


def misc_images(assigned: DataFrame) -> DataFrame:
    """Decoded images before any clause, numbered per document."""
    images = _exploded_images(assigned).filter("clause_id IS NULL")
    return (
        ordinal(images, ["document_id"], ["seg"], ["pos", "img_no"], "number")
        .selectExpr("*", f"{tx.image_format('img.data')} AS format")
        .selectExpr(
            "document_id", "number",
            f"concat('output_images/', document_id, '/misc/misc_', number, '_', {_image_ref('img.key')}, '.', format)"
            " AS path",
            "caption_text AS caption", "format", "img.key AS original_key", "length(img.data) AS size_bytes",
        )
    )


def clause_dim(opened: DataFrame) -> DataFrame:
    """One row per clause. The title of the first opening stays; a reopened id is the same clause."""
    return opened.groupBy("document_id", "clause_id").agg(
        F.min_by("title", "pos").alias("title"), F.min("pos").alias("first_pos")
    )


def clause_tree(clauses: DataFrame) -> DataFrame:
    """Adds ``tree_parent_id``, the parent among the clauses that exist: numeric ids drop the last part,
    annex ids go to their first part."""
    wanted = (
        rf"CASE WHEN regexp_like(clause_id, r'^\d') THEN {tx.parent_by_last_dot('clause_id')}"
        " WHEN contains(clause_id, '.') THEN substring_index(clause_id, '.', 1) END AS wanted"
    )
    parents = clauses.selectExpr("document_id", "clause_id AS wanted", "clause_id AS tree_parent_id")
    return clauses.selectExpr("*", wanted).join(parents, ["document_id", "wanted"], "left").drop("wanted")


def root_clauses(tree: DataFrame) -> DataFrame:
    return tree.filter("tree_parent_id IS NULL").drop("tree_parent_id")


def order_roots(tree: DataFrame, mode: str = "full") -> DataFrame:
    """Root clauses in document order of their ids: numeric by integer parts, then annexes by name.
    ``basic`` compares numeric ids as strings."""
    by_name = r"concat(CASE WHEN regexp_like(clause_id, r'^\d') THEN '0|' ELSE '1|' END, clause_id)"
    key = by_name if _basic(mode) else tx.clause_sort_key("clause_id")
    return root_clauses(tree).selectExpr("*", f"{key} AS sort_key").orderBy("document_id", "sort_key")


def document_statistics(assigned: DataFrame) -> DataFrame:
    """Images, tables and clauses per document."""
    counted = assigned.selectExpr(
        "document_id", "clause_id", "opened_id", f"({_IS_TABLE}) AS is_table", f"coalesce(size({_IMAGES}), 0) AS n"
    )
    return counted.groupBy("document_id").agg(
        F.expr("sum(n)").alias("total_images"),
        F.expr("sum(CASE WHEN clause_id IS NOT NULL THEN n ELSE 0 END)").alias("images_in_clauses"),
        F.expr("sum(CASE WHEN clause_id IS NULL THEN n ELSE 0 END)").alias("images_in_misc"),
        F.expr("count_if(is_table)").alias("total_tables"),
        F.expr("count(DISTINCT opened_id)").alias("total_clauses"),
    )


def _items(assigned: DataFrame, mode: str, words: dict[str, str]) -> DataFrame:
    """Per block the pieces it adds to its clause, ready to collect in position order."""
    images = [] if "imgs" in assigned.columns else [f"{_HEADS_OF_IMAGES} AS imgs"]
    return (
        assigned.filter("clause_id IS NOT NULL")
        .selectExpr("*", f"{_content_type(mode)} AS content_type", f"{_keyword(mode, words)} AS keyword", *images)
        .selectExpr(
            "document_id", "seg", "clause_id",
            "CASE WHEN content_type IS NOT NULL THEN struct(pos, content_type AS type, text) END AS c",
            f"CASE WHEN keyword IS NOT NULL THEN struct(pos, {tx.lookup('keyword', words)} AS type, keyword, text) END AS r",
            f"CASE WHEN {_IS_TABLE} THEN struct(pos, html, {_table_number(mode)} AS number, caption_text AS caption, rows)"
            " END AS t",
            f"CASE WHEN size(imgs) > 0 THEN transform(imgs, (e, i) -> struct(pos, i AS i, {_figure_number(mode)} AS number,"
            f" {_format(mode, 'e.data')} AS format, e.key AS original_key, e.size_bytes AS size_bytes,"
            " caption_text AS caption)) END AS f",
        )
    )


#: The lists of a part whose elements are numbered through its clause.
_COUNTED = ("tables", "figures", "requirements")


def _pieces_before(parts: DataFrame) -> DataFrame:
    """For the later parts of a long clause: how many tables, figures and requirements came before."""
    w = f"OVER (PARTITION BY document_id, clause_id ORDER BY part {_PRIOR})"
    sums = [f"sum(CAST(n_{c} AS BIGINT)) {w} AS {c}_before" for c in _COUNTED]
    return parts.selectExpr("document_id", "clause_id", "part", *sums).filter(" OR ".join(f"{c}_before > 0" for c in _COUNTED))


def _in_order(col: str, *fields: str) -> str:
    picked = ", ".join(f"x.{f} AS {f}" for f in fields)
    return f"transform(array_sort({col}), x -> struct({picked})) AS {col}"


def make_chunks(
    blocks: DataFrame,
    mode: str = "full",
    words: dict[str, str] = tx.NORMATIVE_WORDS,
    segment_rows: int = SEGMENT_ROWS,
    long_documents: bool | None = None,
) -> DataFrame:
    """One chunk per clause with its content, tables, figures, requirements and children.

    A clause that spans more than one segment continues in rows with a higher ``part``, so that no array
    grows without bound; title and parent stand in every part, and a part lists the children that open in
    its segment. The grouping reuses the (document, segment) shuffle of ``assign_blocks``.
    """
    if long_documents is None:
        long_documents = has_long_documents(blocks, segment_rows)
    assigned = assign_blocks(blocks, mode, segment_rows, long_documents, lean=True)
    # Written, so that what the windows shuffle goes before what the joins shuffle comes.
    parts = stage(
        _items(assigned, mode, words)
        .groupBy("document_id", "seg", "clause_id")
        .agg(
            F.expr("collect_list(c)").alias("content"),
            F.expr("collect_list(r)").alias("requirements"),
            F.expr("collect_list(t)").alias("tables"),
            F.expr("flatten(collect_list(f))").alias("figures"),
        )
        .withColumnRenamed("seg", "part")
        .selectExpr("*", *[f"size({c}) AS n_{c}" for c in _COUNTED]),
        "parts",
    )
    openings = open_clauses(assign_blocks(headers_only(blocks), mode, segment_rows, long_documents))
    tree = clause_tree(clause_dim(openings))
    # Children are collected per segment of their first position, so this list is bounded as well.
    children = (
        tree.filter("tree_parent_id IS NOT NULL")
        .selectExpr(
            "document_id", "tree_parent_id AS clause_id", f"{segment_of('first_pos', segment_rows)} AS part",
            "struct(first_pos, clause_id AS child) AS kid",
        )
        .groupBy("document_id", "clause_id", "part")
        .agg(F.expr("transform(array_sort(collect_list(kid)), x -> x.child)").alias("children_ids"))
    )
    keys = ["document_id", "clause_id"]
    titles = tree.select(*keys, "title", "first_pos")
    # What stands beside the texts is joined first, so that these are shuffled once.
    if long_documents:
        beside = parts.selectExpr(*keys, "part", "true AS _held").join(children, [*keys, "part"], "full").join(titles, keys, "left")
        beside = beside.join(_pieces_before(parts), [*keys, "part"], "left")
        named = beside.selectExpr(*[f"{c} AS _{c}" for c in (*keys, "part")], "* EXCEPT (document_id, clause_id, part)")
        same = " AND ".join(["_held", *[f"{c} <=> _{c}" for c in (*keys, "part")]])
        whole = named.join(parts, F.expr(same), "left").selectExpr(
            "* EXCEPT (document_id, clause_id, part, _held)", *[f"_{c} AS {c}" for c in (*keys, "part")])
    else:
        # Without long documents every clause opens in the part that holds its blocks.
        kids = children.groupBy(*keys).agg(F.expr("collect_list(struct(part, children_ids))").alias("_kids"))
        whole = parts.join(titles.join(kids, keys, "left"), keys, "left").selectExpr(
            "*", "get(filter(_kids, k -> k.part = part), 0).children_ids AS children_ids",
            *[f"CAST(NULL AS BIGINT) AS {c}_before" for c in _COUNTED])
    return whole.selectExpr(
        "document_id", "clause_id AS chunk_id", "part", "title", "first_pos",
        f"part = {segment_of('first_pos', segment_rows)} AS is_first",
        f"{tx.parent_by_last_dot('clause_id')} AS parent_id",
        _in_order("content", "type", "text"),
        _in_order("tables", "html", "number", "caption", "rows"),
        "array_sort(figures) AS figures",
        _in_order("requirements", "type", "keyword", "text"),
        "coalesce(children_ids, CAST(array() AS ARRAY<STRING>)) AS children_ids",
        "coalesce(tables_before, 0L) AS tables_before",
        "coalesce(figures_before, 0L) AS figures_before",
        "coalesce(requirements_before, 0L) AS requirements_before",
    ).selectExpr(
        "* EXCEPT (content, tables, figures, requirements)",
        "coalesce(content, array()) AS content",
        "coalesce(tables, array()) AS tables",
        "coalesce(requirements, array()) AS requirements",
        "transform(coalesce(figures, array()), (x, i) -> struct("
        "coalesce(x.number, CAST(figures_before + i + 1 AS STRING)) AS number,"
        f" {_figure_path(mode, 'chunk_id', 'figures_before + i + 1', 'x.original_key', 'x.format')} AS path,"
        " x.format AS format, x.original_key AS original_key, x.size_bytes AS size_bytes, x.caption AS caption)) AS figures",
    )


def whole_clauses(chunks: DataFrame, keys: tuple[str, str] = ("document_id", "chunk_id")) -> DataFrame:
    """One row per clause, however many parts it has: that of its first part with ``content_text``, ``children_ids``,
    ``has_requirements``, ``has_tables`` and ``has_figures`` of all parts. The text is one value, at most 2 GB;
    :func:`text_passages` gives it in bounded rows.
    """
    seen = {name: f"size({name}) > 0" for name in ("requirements", "tables", "figures")}
    body = chunks.selectExpr("*", f"CASE WHEN size(content) > 0 THEN {tx.joined_text('content')} END AS _own")
    if "is_first" not in chunks.columns:
        flags = [f"{cond} AS has_{name}" for name, cond in seen.items()]
        return body.selectExpr("* EXCEPT (_own)", "coalesce(_own, '') AS content_text", *flags)
    rest = (
        body.filter("NOT is_first")
        .groupBy(*keys)
        .agg(
            F.expr("array_sort(collect_list(struct(part, _own)) FILTER (WHERE _own IS NOT NULL))").alias("_texts"),
            F.expr("array_sort(collect_list(struct(part, children_ids)) FILTER (WHERE size(children_ids) > 0))").alias("_kids"),
            *[F.expr(f"bool_or({cond})").alias(f"_more_{name}") for name, cond in seen.items()],
        )
    )
    return body.filter("is_first").join(rest, list(keys), "left").selectExpr(
        "* EXCEPT (_own, children_ids, _texts, _kids, _more_requirements, _more_tables, _more_figures)",
        # A child may open in a part before that of its parent.
        "flatten(transform(array_sort(concat(array(struct(part, children_ids)), coalesce(_kids, array()))), x -> x.children_ids)) AS children_ids",
        "array_join(concat(array(_own), coalesce(transform(_texts, x -> x._own), array())), ' ') AS content_text",
        *[f"{cond} OR coalesce(_more_{name}, false) AS has_{name}" for name, cond in seen.items()],
    )


def text_passages(chunks: DataFrame, chars: int) -> DataFrame:
    """``title. text`` of each clause in rows ``(document_id, chunk_id, title, passage, text)`` of ``chars`` characters.

    Each part is cut at the passage ends that fall into it and only pieces of one passage meet, so neither a long
    clause nor the size of a segment shows in the result. What stands before a part is a sum over one number per part.
    """
    rows = chunks if "is_first" in chunks.columns else chunks.selectExpr("*", "0L AS part", "true AS is_first")
    keys = ["document_id", "chunk_id"]
    own = rows.selectExpr(
        *keys, "part", "title", "size(content) > 0 AS filled",
        f"concat(CASE WHEN is_first THEN concat(coalesce(title, ''), '. ') ELSE '' END, {tx.joined_text('content')}) AS t",
    )
    prior = f"OVER (PARTITION BY document_id, chunk_id ORDER BY part {_PRIOR})"
    sizes = own.selectExpr(*keys, "part", "length(t) AS n", "CAST(filled AS INT) AS filled")
    # One space stands between two filled parts.
    before = (
        sizes.selectExpr("*", f"coalesce(sum(filled) {prior}, 0) AS full_before")
        .selectExpr("*", "n + CASE WHEN filled = 1 AND full_before > 0 THEN 1 ELSE 0 END AS taken")
        .selectExpr(*keys, "part", "full_before", f"sum(taken) {prior} AS start")
        .filter("start IS NOT NULL")
    )
    placed = own.join(before, [*keys, "part"], "left").selectExpr(
        *keys, "title", "coalesce(start, 0L) AS start", "CASE WHEN filled AND full_before > 0 THEN concat(' ', t) ELSE t END AS t"
    )
    cut = placed.filter("t <> ''").selectExpr(
        "*", f"explode(sequence(start DIV {chars}, (start + length(t) - 1) DIV {chars})) AS passage"
    )
    pieces = cut.selectExpr(
        *keys, "title", "CAST(passage AS INT) AS passage", "start",
        f"substring(t, CAST(greatest(passage * {chars} - start, 0) + 1 AS INT),"
        f" CAST(least((passage + 1) * {chars} - start, {chars}) AS INT)) AS t",
    )
    return pieces.groupBy(*keys, "passage").agg(
        F.min("title").alias("title"),
        F.expr("array_join(transform(array_sort(collect_list(struct(start, t))), x -> x.t), '')").alias("text"),
    )


def chunk_levels(chunks: DataFrame) -> DataFrame:
    """Level, text length and presence flags of a clause; the nested form's level wins unless it is 0."""
    level = r"size(split(chunk_id, r'\.'))"
    if "hierarchy" in chunks.columns:
        level = f"coalesce(nullif(hierarchy.level, 0), {level})"
    return whole_clauses(chunks).selectExpr("*", f"{level} AS level", "length(content_text) AS content_length")


def extract_references(content: DataFrame) -> DataFrame:
    """One row per mention of a clause, table, figure or standard in a content block."""
    listed = content.selectExpr("document_id", "clause_id", "pos", f"{tx.references_struct('text')} AS refs")
    kinds = {"clauses": "clause", "tables": "table", "figures": "figure", "standards": "standard"}
    every = ", ".join(
        f"transform(refs.{field}, v -> struct('{kind}' AS reference_type, v AS target))" for field, kind in kinds.items()
    )
    return listed.selectExpr("document_id", "clause_id", "pos", f"explode(concat({every})) AS ref").select(
        "document_id", "clause_id", "pos", "ref.reference_type", "ref.target"
    )


def chunk_references(chunks: DataFrame) -> DataFrame:
    """Adds ``references``: the mentions in all content of a chunk, without repeats."""
    text = tx.joined_text("content", "\n")
    return chunks.selectExpr("*", f"{text} AS _text").selectExpr(
        "* EXCEPT (_text)", f"{tx.references_struct('_text')} AS references"
    )
