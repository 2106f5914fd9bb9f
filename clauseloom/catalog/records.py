"""Queries over files, the registry, sessions and logs."""

from __future__ import annotations

from functools import partial

import pandas as pd
from pyspark.sql import functions as F

from clauseloom.catalog import fixtures as fx
from clauseloom.operators import markdown as md
from clauseloom.operators import ops
from clauseloom.operators import registry as rg
from clauseloom.operators import sessions as ss
from clauseloom.plans.stage import delete_folder, discard, fresh_path, passing, stage
from clauseloom.sources import files as fl

# ---- fixtures: registry rows from orders, updates from events, sessions from conversations, logs from events


def registry(spark, sf):
    return fx.read(spark, sf, "orders").selectExpr(
        "concat('d', o_orderkey) AS id", "sha2(concat('h', o_orderkey), 256) AS hash",
        "concat(o_orderpriority, '.pdf') AS filename", "CAST(o_orderdate AS TIMESTAMP) AS upload_timestamp",
        "CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'P' THEN 'FAILED' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'PENDING' ELSE 'PROCESSING' END END AS status",
        "CAST(NULL AS STRING) AS marker_version",
        "CAST(o_orderdate AS TIMESTAMP) + make_dt_interval(0, 0, 0, o_orderkey % 50) AS processing_started",
        "CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderdate AS TIMESTAMP) + make_dt_interval(0, 0, 1, o_orderkey % 70) END AS processing_completed",
        "CAST(NULL AS STRING) AS error_message", "CAST(o_orderkey % 3 AS INT) AS retry_count", "3 AS max_retries",
        "CAST(o_orderkey % 90 AS INT) AS page_count", "CAST(o_orderkey % 40 AS INT) AS clause_count", "CAST(o_orderkey % 41 AS INT) AS chunk_count",
    )


SQL_REGISTRY = """
registry AS (SELECT 'd' || o_orderkey AS id, sha256('h' || o_orderkey) AS hash, o_orderpriority || '.pdf' AS filename, o_orderdate AS upload_timestamp,
  CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'P' THEN 'FAILED' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'PENDING' ELSE 'PROCESSING' END END AS status,
  CAST(NULL AS VARCHAR) AS marker_version,
  o_orderdate + to_seconds(o_orderkey % 50) AS processing_started,
  CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate + to_seconds(60 + o_orderkey % 70) END AS processing_completed,
  CAST(NULL AS VARCHAR) AS error_message, o_orderkey % 3 AS retry_count, 3 AS max_retries, o_orderkey % 90 AS page_count,
  o_orderkey % 40 AS clause_count, o_orderkey % 41 AS chunk_count, o_orderkey FROM orders)"""


def registry_chunks(spark, sf):
    return fx.read(spark, sf, "lineitem").selectExpr("concat('d', l_orderkey * 2) AS document_id", "concat('c', l_partkey % 5) AS chunk_id")


def updates(spark, sf):
    return fx.read(spark, sf, "events").selectExpr(
        "concat('d', user_id) AS document_id", "CAST(ts AS TIMESTAMP) AS ts", "event_id AS seq",
        "CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'click' THEN 'PROCESSING' WHEN 'view' THEN 'COMPLETED_MARKER' WHEN 'purchase' THEN 'COMPLETED' ELSE 'FAILED' END AS status",
        "CASE WHEN event_type = 'error' THEN props END AS error_message",
        "CASE WHEN event_type = 'view' THEN concat('v', user_id) END AS marker_version",
        "CASE WHEN event_type = 'purchase' THEN CAST(value AS INT) END AS page_count",
    )


SQL_UPDATES = """
updates AS (SELECT 'd' || user_id AS id, ts, event_id AS seq,
  CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'click' THEN 'PROCESSING' WHEN 'view' THEN 'COMPLETED_MARKER' WHEN 'purchase' THEN 'COMPLETED' ELSE 'FAILED' END AS status,
  CASE WHEN event_type = 'error' THEN props END AS error_message, CASE WHEN event_type = 'view' THEN 'v' || user_id END AS marker_version,
  CASE WHEN event_type = 'purchase' THEN CAST(trunc(value) AS INT) END AS page_count FROM events)"""


def failures(spark, sf):
    return fx.read(spark, sf, "events").filter("event_type = 'error'").selectExpr(
        "concat('d', user_id) AS document_id", "event_id AS seq", "concat('E', props) AS error")


def _made_sessions(spark, sf):
    rows = fx.read(spark, sf, "conversations").selectExpr(
        "conv_id", "struct(turn, role, text AS content, CAST(NULL AS STRING) AS timestamp, concat('m', conv_id, '-', turn) AS message_id) AS m")
    return rows.groupBy("conv_id").agg(F.expr("array_sort(collect_list(m))").alias("ms")).selectExpr(
        "concat('s', conv_id) AS session_id", "concat('u', conv_id % 7) AS user_id", "concat('Chat ', substring(ms[0].content, 1, 12)) AS title",
        "timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, conv_id) AS created_at",
        "timestamp'2024-01-02 00:00:00' + make_dt_interval(0, 0, 0, conv_id * 37 % 101) AS updated_at",
        "conv_id % 3 = 0 AS starred", "map(ms[0].message_id, concat('/files/', conv_id, '.docx')) AS test_plan_files",
        "transform(ms, x -> struct(x.role, x.content, x.timestamp, x.message_id)) AS messages")


def sessions(spark, sf):
    """Sessions written as JSON lines and read back."""
    path = fresh_path(spark, "sessions")
    _made_sessions(spark, sf).write.json(path)
    return fl.read_sessions(spark, path, lines=True)


def read_sessions_files(spark, sf):
    """A file of many lines per session, every eleventh of them broken off."""
    made, path = _made_sessions(spark, sf), fresh_path(spark, "session-files")
    whole = made.selectExpr("session_id AS folder", f"to_json(struct({', '.join(made.columns)}), map('pretty', 'true')) AS value")
    cut = "CASE WHEN CAST(substring(folder, 2) AS BIGINT) % 11 = 3 THEN substring(value, 1, length(value) - 20) ELSE value END AS value"
    whole.selectExpr("folder", cut).repartition("folder").write.partitionBy("folder").text(path)
    found = fl.read_sessions(spark, path)
    return found.selectExpr(*_SESSION_COLS, "size(messages) AS n_messages", "md5(array_join(transform(messages, m -> m.content), '|')) AS contents")




SQL_SESSIONS = """
firsts AS (SELECT conv_id, arg_min(text, turn) AS t0, min(turn) AS turn0 FROM conversations GROUP BY conv_id),
sessions AS (SELECT conv_id, 's' || conv_id AS session_id, 'u' || conv_id % 7 AS user_id, 'Chat ' || t0[1:12] AS title,
  TIMESTAMP '2024-01-01' + to_seconds(conv_id) AS created_at, TIMESTAMP '2024-01-02' + to_seconds(conv_id * 37 % 101) AS updated_at,
  conv_id % 3 = 0 AS starred, 'm' || conv_id || '-' || turn0 AS message_id FROM firsts)"""
_SESSION_COLS = ("session_id", "user_id", "title", "created_at", "updated_at", "starred")


def log_lines(spark, sf):
    """Access lines and messages written as a log that was rotated twice, and read back."""
    events = fx.read(spark, sf, "events")
    last = events.agg(F.max("event_id")).first()[0]
    lines = events.selectExpr(
        "event_id", f"concat('app.log', CASE WHEN event_id * 3 < {last} THEN '.2' WHEN event_id * 3 < {2 * last} THEN '.1' ELSE '' END) AS log",
        """concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), ' ', event_id, ' ', CASE event_type
             WHEN 'error' THEN concat('Fatal: ', CASE WHEN user_id % 3 = 0 THEN 'no error' ELSE 'connection refused' END, ' ', props)
             WHEN 'view' THEN concat('"GET /', CASE user_id % 4 WHEN 0 THEN 'test/a' WHEN 1 THEN 'api/auth/signup' ELSE 'api/x' END, ' HTTP/1.1" ', CASE event_id % 4 WHEN 0 THEN 200 WHEN 1 THEN 400 WHEN 2 THEN 404 ELSE 503 END)
             WHEN 'click' THEN concat('Warning: old ', props)
             WHEN 'purchase' THEN concat('Traceback in job ', user_id)
             ELSE concat('ok ', value) END) AS value""")
    path = fresh_path(spark, "logs")
    lines.repartition("log").sortWithinPartitions("log", "event_id").select("log", "value").write.partitionBy("log").text(path)
    return fl.read_logs(spark, path, named_by="folder")


SQL_LOGS = """
logs AS (SELECT row_number() OVER (ORDER BY event_id) AS line_no, ts, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || event_id || ' ' || CASE event_type
   WHEN 'error' THEN 'Fatal: ' || CASE WHEN user_id % 3 = 0 THEN 'no error' ELSE 'connection refused' END || ' ' || props
   WHEN 'view' THEN '"GET /' || CASE user_id % 4 WHEN 0 THEN 'test/a' WHEN 1 THEN 'api/auth/signup' ELSE 'api/x' END || ' HTTP/1.1" ' || CASE event_id % 4 WHEN 0 THEN 200 WHEN 1 THEN 400 WHEN 2 THEN 404 ELSE 503 END
   WHEN 'click' THEN 'Warning: old ' || props WHEN 'purchase' THEN 'Traceback in job ' || user_id ELSE 'ok ' || value END AS line, lower(line) AS low FROM events),
http AS (SELECT line_no, regexp_extract(line, '"(\\w+)\\s+([^\\s]+)\\s+HTTP[^"]*"\\s+(\\d{3})', 1) AS m, regexp_extract(line, '"(\\w+)\\s+([^\\s]+)\\s+HTTP[^"]*"\\s+(\\d{3})', 2) AS p,
   TRY_CAST(regexp_extract(line, '"(\\w+)\\s+([^\\s]+)\\s+HTTP[^"]*"\\s+(\\d{3})', 3) AS INT) AS st FROM logs WHERE regexp_matches(line, 'HTTP[^"]*" \\d{3}')),
http_errors AS (SELECT 'app.log' AS source, line_no, CASE WHEN st >= 500 THEN 'critical' WHEN st >= 404 THEN 'error' ELSE 'warning' END AS severity,
   'HTTP ' || st || ': ' || m || ' ' || p AS message, 'http' AS type FROM http WHERE st >= 400 AND NOT contains(p, '/test') AND NOT (st = 400 AND contains(p, '/api/auth/signup'))),
server AS (SELECT 'app.log' AS source, line_no, CASE WHEN contains(line, 'Warning:') THEN 'warning'
     WHEN (contains(low, 'error') OR contains(low, 'exception') OR contains(low, 'traceback') OR contains(low, 'failed') OR contains(low, 'fatal'))
       AND NOT (contains(low, '200 ok') OR contains(low, '304') OR contains(low, '301') OR contains(low, '302') OR contains(low, 'no error')) THEN 'error' END AS severity,
   line[1:300] AS message, CASE WHEN contains(line, 'Warning:') THEN 'warning' ELSE 'exception' END AS type FROM logs WHERE NOT regexp_matches(line, 'HTTP[^"]*" \\d{3}')),
all_errors AS (SELECT * FROM http_errors UNION ALL SELECT * FROM server WHERE severity IS NOT NULL)"""


def errors(spark, sf):
    lines = log_lines(spark, sf)
    return ops.parse_http_errors(lines).unionByName(ops.classify_log_lines(lines, "server"))


def _messages(spark, sf):
    """Whole messages, some of them long, and an empty one beside each third."""
    told = fx.read(spark, sf, "conversations")
    return told.selectExpr("conv_id", "turn", "CASE WHEN turn = 4 THEN repeat(text, 9) ELSE text END AS content").unionByName(
        told.filter("turn = 3").selectExpr("conv_id", "-1 AS turn", "'' AS content"))


def requests(spark, sf):
    """Events as requests: one bucket per event type, time pressed together 3000 times."""
    return ops.request_costs(fx.read(spark, sf, "events").selectExpr(
        "event_type AS key", "event_id AS request_id", "CAST(floor(unix_micros(CAST(ts AS TIMESTAMP)) / 3000) AS BIGINT) AS ts_us",
        "CASE user_id % 5 WHEN 0 THEN '/api/v2/test-plan' WHEN 1 THEN '/ws/chat' WHEN 2 THEN '/health' ELSE '/api/chat' END AS path"))


def rate_limit_replay(spark, sf):
    return ops.rate_limit_replay(requests(spark, sf)).withColumn("retry_after", F.expr("round(retry_after, 6)"))


def rate_limit_split(spark, sf):
    """The same with every key cut into segments, and the global bucket."""
    one = requests(spark, sf).withColumn("key", F.lit("all"))
    return ops.rate_limit_replay(one, ops.GLOBAL_BUCKET, whole_rows=0, segment_us=60_000_000).withColumn("retry_after", F.expr("round(retry_after, 6)"))


def written_texts(spark, sf):
    path = fresh_path(spark, "texts")
    docs = fx.read(spark, sf, "documents").selectExpr("text", "lang")
    docs.write.partitionBy("lang").text(path)
    return path


def scan_files(spark, sf):
    files = fl.scan_files(spark, written_texts(spark, sf))
    return files.groupBy(F.expr("regexp_extract(path, 'lang=([a-z]+)', 1)").alias("lang"), "file_type", "supported").agg(F.sum("file_size").alias("bytes"))


def source_summary(spark, sf):
    return fl.source_summary(fl.scan_files(spark, written_texts(spark, sf))).select("valid", "total_size", "unsupported_count", "error_message")


def extract_documents(spark, sf):
    """Texts through the built-in extractor, its JSON parsed and flattened again."""
    files = fx.read(spark, sf, "documents").selectExpr(
        "CAST(doc_id AS STRING) AS path", "concat(doc_id, '.txt') AS filename", "encode(text, 'UTF-8') AS content", "true AS supported")
    out = fl.extract_documents(fx.spread_small(files))
    trees, _ = fl.parse_block_trees(out.filter("error IS NULL"), "path", "tree")
    return fl.flatten_blocks(trees).selectExpr("document_id", "pos", "block_type", "md5(html) AS html_hash")


def _tree_texts(spark, sf):
    """The layout blocks as nested JSON, three to a page group; some of it is broken off."""
    blocks = fx.document_blocks(spark, sf).selectExpr("document_id", "pos", "struct(pos % 3 AS o, block_type, html, caption, rows) AS b")
    # Both groupings use one shuffle by document.
    pages = blocks.repartition("document_id").groupBy("document_id", F.expr("CAST(floor(pos / 3) AS INT)").alias("page")).agg(F.expr("array_sort(collect_list(b))").alias("children"))
    group = "struct(page, CASE WHEN page % 9 = 8 THEN 'PageFooter' ELSE 'Group' END AS block_type, children) AS p"
    docs = pages.selectExpr("document_id", group).groupBy("document_id").agg(F.expr("array_sort(collect_list(p))").alias("children"))
    return docs.selectExpr("document_id", "concat(to_json(struct(children)), '') AS j").withColumn(
        "j", F.expr("CASE WHEN substring(document_id, -1) = '7' THEN substring(j, 1, length(j) - 3) ELSE j END"))


def flatten_blocks(spark, sf):
    """Block trees parsed back into rows; broken JSON is rejected."""
    return _flattened(*fl.parse_block_trees(_tree_texts(spark, sf), "document_id", "j"))


def _write_folders(texts, path):
    """A file per row in a folder ``document=...``. Tasks write the files in place: Spark's writer spends tens of milliseconds on each and
    moves one folder after the other in the end. A store that Arrow does not know is left to that writer."""
    from pyarrow import ArrowInvalid, fs

    uri = path if ":" in path.split("/")[0] else f"file://{path}"
    try:
        fs.FileSystem.from_uri(uri)
    except (ArrowInvalid, OSError, NotImplementedError):
        return texts.repartition("document").write.partitionBy("document").text(path)

    def write(batches):
        store, root = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for document, value in zip(batch["document"], batch["value"]):
                folder = f"{root}/document={document}"
                store.create_dir(folder, recursive=True)
                # A task that is repeated writes the same file again.
                with store.open_output_stream(f"{folder}/tree.txt") as out:
                    out.write(f"{value}\n".encode())
            yield pd.DataFrame({"n": [len(batch)]})

    return texts.mapInPandas(write, "n long").agg(F.sum("n")).collect()


def read_block_trees(spark, sf):
    """The same from files, one per document in a folder of its own."""
    path = fresh_path(spark, "trees")
    with passing():
        _write_folders(_tree_texts(spark, sf).selectExpr("coalesce(document_id, '__HIVE_DEFAULT_PARTITION__') AS document", "j AS value"), path)
    trees, rejects = fl.read_block_trees(spark, path, named_by="folder")
    delete_folder(path)
    out = _flattened(trees, stage(rejects.select("document_id", "error"), "rejects"))
    discard(trees)
    return out


def _flattened(trees, rejects):
    rows = fl.flatten_blocks(trees).selectExpr("document_id", "pos", "block_type", "html", "caption", "to_json(rows) AS rows")
    return rows.unionByName(rejects.selectExpr("document_id", "-1L AS pos", "error AS block_type"), allowMissingColumns=True)


def event_log(spark, sf):
    """Events published as JSON lines and read back."""
    events = fx.read(spark, sf, "events").selectExpr(
        "concat('e', event_id) AS event_id", "upper(event_type) AS event_type", "concat('d', user_id) AS document_id",
        "CAST(ts AS TIMESTAMP) AS ts", "concat('document.', event_type) AS routing_key", "value")
    path = fresh_path(spark, "events")
    fl.publish_events(events, path)
    return fl.read_event_log(spark, path).selectExpr(
        "event_id", "event_type", "document_id", "ts", "routing_key", "CAST(get_json_object(payload, '$.value') AS DOUBLE) AS value")


def write_chunks(spark, sf):
    from clauseloom.catalog.graph import chunks
    path = fresh_path(spark, "chunks")
    made = chunks(spark, sf)
    fl.write_chunks(made, path)
    back = spark.read.schema(made.schema).json(path)
    return back.selectExpr("document_id", "chunk_id", "title", "size(content) AS n_content", "size(children_ids) AS n_children")


def dedup_documents(spark, sf):
    docs = fx.read(spark, sf, "documents")
    incoming = rg.with_content_hash(docs.selectExpr("CAST(doc_id AS STRING) AS path", "text"), "text").select("path", "content_hash")
    known = fx.read(spark, sf, "benchmark").selectExpr("concat('b', item_id) AS id", "sha2(text, 256) AS hash").unionByName(
        fx.read(spark, sf, "labels").join(docs, "doc_id").filter("quality = 1").selectExpr("concat('k', doc_id) AS id", "sha2(text, 256) AS hash"))
    return rg.dedup_documents(incoming, known)


def object_key(spark, sf):
    return rg.object_key(registry(spark, sf), "hash", "filename", "upload_timestamp").select("id", "object_key")


def register_documents(spark, sf):
    docs = fx.read(spark, sf, "documents").selectExpr("sha2(text, 256) AS content_hash", "concat(doc_id, '.txt') AS filename", "timestamp'2024-02-03 04:05:06' AS ts")
    return rg.register_documents(docs, "ts")


def markdown(spark, sf):
    """``documents`` as markdown reports: every whole line in a heading, table, rule, note or with bold and subscript marks.

    What stands between a rule and the end of a chapter is cleaned away; two documents of three have no such end."""
    line = """CASE pos % 9 WHEN 0 THEN concat(repeat('#', CAST(1 + doc_id % 6 AS INT)), ' ', l) WHEN 1 THEN concat('| ', l, ' | b |')
      WHEN 2 THEN concat('| ', l, ' | c |\n|---|:-:|') WHEN 3 THEN concat('| **', l, '** | ', pos, ' | z |') WHEN 4 THEN concat('some **bold ', l, '** and H<sub>2</sub>O<br/>end')
      WHEN 5 THEN concat(replace(l, '|', '/'), '\n# ', pos, '\n---\n## rest') WHEN 6 THEN concat('> Note: ', l)
      WHEN 7 THEN concat(replace(l, '|', '/'), CASE WHEN doc_id % 3 = 0 THEN concat('\n--- End of Chapter ', pos, ' ---') ELSE '' END) ELSE replace(l, '|', '/') END"""
    rows = fx.marked_lines(spark, sf).selectExpr("doc_id", f"struct(pos, {line} AS s) AS x")
    return rows.groupBy("doc_id").agg(F.expr(r"array_join(transform(array_sort(collect_list(x)), y -> y.s), '\n')").alias("md")).selectExpr(
        "doc_id", f"{md.clean_markdown('md')} AS md", "md AS raw")


SQL_MARKDOWN = fx.SQL_BLOCKS + """,
md_lines AS (SELECT doc_id, pos, CASE pos % 9 WHEN 0 THEN repeat('#', CAST(1 + doc_id % 6 AS INT)) || ' ' || l WHEN 1 THEN '| ' || l || ' | b |'
   WHEN 2 THEN '| ' || l || ' | c |' || chr(10) || '|---|:-:|' WHEN 3 THEN '| **' || l || '** | ' || pos || ' | z |' WHEN 4 THEN 'some **bold ' || l || '** and H<sub>2</sub>O<br/>end'
   WHEN 5 THEN replace(l, '|', '/') || chr(10) || '# ' || pos || chr(10) || '---' || chr(10) || '## rest' WHEN 6 THEN '> Note: ' || l
   WHEN 7 THEN replace(l, '|', '/') || CASE WHEN doc_id % 3 = 0 THEN chr(10) || '--- End of Chapter ' || pos || ' ---' ELSE '' END ELSE replace(l, '|', '/') END AS s FROM lines),
raw AS (SELECT doc_id, string_agg(s, chr(10) ORDER BY pos) AS raw FROM md_lines GROUP BY doc_id),
clean AS (SELECT doc_id, regexp_replace(regexp_replace(raw, '(?is)---.*?(End of Chapter|Next:).*?---', '', 'g'), '(?i)> Note:.*?\\n', '', 'g') AS md FROM raw),
toks AS (SELECT doc_id, unnest(t) AS token, unnest(range(len(t))) AS token_no FROM (SELECT doc_id, list_filter(list_transform(
   string_split(regexp_replace(md, '(?m)((?:^\\s*\\|.*\\|(?:\\n\\s*\\|.*\\|)*)|(?:^\\s*#{1,6}\\s+.*$))', chr(1) || '\\1' || chr(1), 'g'), chr(1)),
   lambda x: """ + fx.sql_strip("x") + """), lambda x: x <> '') AS t FROM clean)),
md_cells AS (SELECT doc_id, token_no, list_filter(list_transform(string_split(token, chr(10)), lambda r: """ + fx.sql_strip("r") + """), lambda r: r <> '' AND NOT regexp_matches(r, '^\\|?[\\s\\-:|]+\\|?$')) AS rs
   FROM toks WHERE starts_with(token, '|')),
md_rows AS (SELECT doc_id, token_no, list_max(list_transform(rs, lambda r: length(r) - length(replace(r, '|', '')))) - 1 AS ncol, unnest(rs) AS r, unnest(range(len(rs))) AS row_no FROM md_cells)"""


QUERIES = {
    "scan_files": scan_files,
    "source_summary": source_summary,
    "with_content_hash": lambda s, d: rg.with_content_hash(fx.read(s, d, "documents").select("doc_id", "text"), "text").drop("text"),
    "dedup_documents": dedup_documents,
    "object_key": object_key,
    "register_documents": register_documents,
    "registry_lookup": lambda s, d: rg.registry_lookup(registry(s, d), fx.read(s, d, "lineitem").selectExpr("sha2(concat('h', l_orderkey * 3), 256) AS hash"), "hash").select("id", "hash", "status"),
    "list_documents": lambda s, d: rg.list_documents(registry(s, d), 50, 25).select("id", "status", "upload_timestamp"),
    "flatten_blocks": flatten_blocks,
    "read_block_trees": read_block_trees,
    "read_sessions_files": read_sessions_files,
    "read_logs": lambda s, d: log_lines(s, d).selectExpr("source", "rotation", "line_no", "date_format(ts, 'yyyy-MM-dd HH:mm:ss') AS ts", "md5(line) AS line_hash"),
    "extract_documents": extract_documents,
    "write_chunks": write_chunks,
    "event_log": event_log,
    "table_inventory": lambda s, d: rg.table_inventory({t: fx.read(s, d, t) for t in ("documents", "events", "orders", "lineitem", "labels")}),
    "newest_sample": lambda s, d: rg.newest_sample(registry(s, d), "upload_timestamp", "id", 10).select("id", "upload_timestamp"),
    "clean_markdown": lambda s, d: markdown(s, d).select("doc_id", "md"),
    "markdown_blocks": lambda s, d: md.markdown_blocks(markdown(s, d), "doc_id", "md").select("doc_id", "token_no", "line_no", "kind", "level", "text"),
    "markdown_table_cells": lambda s, d: md.markdown_table_cells(md.markdown_blocks(markdown(s, d), "doc_id", "md"), "doc_id"),
    "inline_runs": lambda s, d: md.inline_runs(md.markdown_blocks(markdown(s, d), "doc_id", "md").filter("kind = 'paragraph'"), ["doc_id", "token_no", "line_no"], "text"),
    "active_documents": lambda s, d: rg.active_documents(registry(s, d)).select("id", "status", "processing_duration_seconds"),
    "failed_documents": lambda s, d: rg.failed_documents(registry(s, d), fx.read(s, d, "lineitem").selectExpr(
        "concat('d', l_orderkey) AS document_id", "concat('stage', l_linenumber) AS failure_stage", "l_linestatus = 'F' AS reviewed", "CAST(NULL AS STRING) AS reviewed_by")).select("id", "failure_stage", "reviewed"),
    "processing_summary": lambda s, d: rg.processing_summary(registry(s, d), registry_chunks(s, d)).drop("filename", "processing_completed"),
    "daily_statistics": lambda s, d: rg.daily_statistics(registry(s, d)).withColumn("avg_total_time", F.expr("CAST(avg_total_time AS DOUBLE)")),
    "stage_times": lambda s, d: rg.stage_times(fx.read(s, d, "events").selectExpr(
        "user_id AS document_id", "CAST(ts AS TIMESTAMP) AS ts",
        "CASE event_type WHEN 'click' THEN 'PROCESSING_MARKER' WHEN 'view' THEN 'COMPLETED_MARKER' WHEN 'purchase' THEN 'PROCESSING_GRAPH' WHEN 'error' THEN 'COMPLETED_GRAPH' ELSE 'PENDING' END AS status",
    )).withColumn("avg_time", F.expr("CAST(avg_time AS DOUBLE)")),
    "insert_if_absent": lambda s, d: rg.insert_if_absent(
        fx.read(s, d, "customer").selectExpr("c_custkey AS k", "c_mktsegment AS v"),
        fx.read(s, d, "orders").selectExpr("o_custkey * 2 AS k", "o_orderpriority AS v"), "k"),
    "apply_status_updates": lambda s, d: rg.apply_status_updates(registry(s, d), updates(s, d)).select(
        "id", "status", "processing_started", "processing_completed", "error_message", "marker_version", "page_count"),
    "route_failures": lambda s, d: rg.route_failures(registry(s, d), failures(s, d))[0],
    "route_failures_registry": lambda s, d: rg.route_failures(registry(s, d), failures(s, d))[1].select("id", "status", "retry_count", "error_message"),
    "manual_retry": lambda s, d: rg.manual_retry(registry(s, d), fx.read(s, d, "lineitem").selectExpr("concat('d', l_orderkey * 2) AS id")),
    "cascade_delete": lambda s, d: rg.cascade_delete({"chunks": (registry_chunks(s, d), "document_id")}, registry(s, d).filter("status = 'FAILED'"))["chunks"].groupBy("chunk_id").agg(F.count("*").alias("n")),
    "ingestion_report": lambda s, d: rg.ingestion_report(_job_files(s, d)),
    "ingestion_errors": lambda s, d: rg.ingestion_errors(_job_files(s, d)),
    "list_sessions": lambda s, d: ss.list_sessions(sessions(s, d)).select(*_SESSION_COLS),
    "search_sessions": lambda s, d: _search(s, d),
    "search_sessions_many": lambda s, d: search_sessions_many(s, d),
    "update_sessions": lambda s, d: _update_sessions(s, d),
    "session_titles": lambda s, d: ss.session_titles(fl.session_messages(sessions(s, d))),
    "list_users": lambda s, d: ss.list_users(fx.read(s, d, "customer").selectExpr("c_custkey AS user_id", "c_name AS username", "CASE WHEN c_custkey % 10 <> 0 THEN timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, c_custkey * 7 % 997) END AS created_at")),
    "username_conflicts": lambda s, d: ss.username_conflicts(
        fx.read(s, d, "orders").selectExpr("o_orderkey AS signup_id", "concat('u', o_custkey * 3) AS username"),
        fx.read(s, d, "customer").selectExpr("concat('u', c_custkey) AS username")),
    "generated_file_lookup": lambda s, d: ss.generated_file_lookup(sessions(s, d), fx.read(s, d, "conversations").selectExpr("concat('m', conv_id, '-', turn) AS message_id")),
    "message_rules": lambda s, d: ss.message_rules(_messages(s, d)).drop("content"),
    "parse_http_errors": lambda s, d: ops.parse_http_errors(log_lines(s, d)),
    "classify_log_lines": lambda s, d: ops.classify_log_lines(log_lines(s, d), "server"),
    "classify_log_lines_container": lambda s, d: ops.classify_log_lines(log_lines(s, d), "container"),
    "classify_log_lines_container_tail": lambda s, d: ops.classify_log_lines(log_lines(s, d), "container_tail"),
    "classify_log_lines_server_tail": lambda s, d: ops.classify_log_lines(log_lines(s, d), "server_tail"),
    "classify_log_lines_health": lambda s, d: ops.classify_log_lines(log_lines(s, d), "health"),
    "tail_lines": lambda s, d: ops.tail_lines(log_lines(s, d), 100).select("line_no", "line"),
    "rank_errors": lambda s, d: ops.rank_errors(errors(s, d), 100).drop("type"),
    "error_summary": lambda s, d: ops.error_summary(errors(s, d)),
    "dedupe_errors": lambda s, d: ops.dedupe_errors(errors(s, d).withColumn("message", F.expr("regexp_replace(message, '^[0-9: -]+ ', '')")), 20),
    "recent_samples": lambda s, d: ops.recent_samples(fx.read(s, d, "events").selectExpr("event_type AS metric", "ts", "event_id AS sample_id", "value")).select("metric", "sample_id", "rank", "shown"),
    "run_metrics": lambda s, d: ops.run_metrics(fx.read(s, d, "events").selectExpr("user_id AS run_id", "CAST(value AS DECIMAL(12, 2)) AS seconds")).selectExpr("run_id", "calls", "CAST(total_sec AS DOUBLE) AS total_sec"),
    "chapter_times": lambda s, d: ops.chapter_times(fx.read(s, d, "events").selectExpr("user_id AS run_id", "event_type AS chapter", "CAST(value AS DECIMAL(12, 2)) AS seconds")).withColumn("seconds", F.expr("CAST(seconds AS DOUBLE)")),
    "rate_limit_replay": rate_limit_replay,
    "rate_limit_split": rate_limit_split,
}


def _job_files(spark, sf):
    return fx.read(spark, sf, "events").selectExpr(
        "user_id AS job_id", "concat('f', event_id) AS path",
        "CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'duplicate' WHEN 'click' THEN CASE WHEN user_id % 2 = 0 THEN 'success' END ELSE 'success' END AS outcome",
        "CASE WHEN event_type = 'error' THEN props END AS error", "CAST(ts AS TIMESTAMP) AS started",
        "CAST(ts AS TIMESTAMP) + INTERVAL 2 SECONDS AS ended")


def _search(spark, sf):
    found = sessions(spark, sf)
    return ss.search_sessions(found, fl.session_messages(found), "Que LA").select("session_id", "title")


def search_sessions_many(spark, sf):
    """What each conversation begins with, from no character to seven, as a search of its own."""
    found = sessions(spark, sf)
    asked = fx.read(spark, sf, "conversations").filter("turn = 1").selectExpr("conv_id AS search_id", "upper(substring(text, 3, conv_id % 8)) AS q")
    return ss.search_sessions_many(found, fl.session_messages(found), asked).select("search_id", "session_id", "title")


def _update_sessions(spark, sf):
    changes = fx.read(spark, sf, "conversations").selectExpr(
        "concat('s', conv_id) AS session_id", "turn AS seq",
        "CASE WHEN turn % 3 = 0 THEN 'star' WHEN turn % 3 = 1 THEN 'rename' WHEN conv_id % 10 = 4 THEN 'delete' ELSE 'star' END AS action",
        "concat('T', turn) AS title", "timestamp'2024-03-01 00:00:00' + make_dt_interval(0, 0, 0, turn) AS ts")
    return ss.update_sessions(sessions(spark, sf), changes).select(*_SESSION_COLS)


_r = partial(fx.with_ctes, SQL_REGISTRY)
_s = partial(fx.with_ctes, SQL_SESSIONS)
_l = partial(fx.with_ctes, SQL_LOGS)
_DUR = "epoch_us({b}) - epoch_us({a})"
_JOB = """
files AS (SELECT user_id AS job_id, 'f' || event_id AS path, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'duplicate' WHEN 'click' THEN CASE WHEN user_id % 2 = 0 THEN 'success' END ELSE 'success' END AS outcome,
  CASE WHEN event_type = 'error' THEN props END AS error, ts FROM events)"""
_BUCKET = """
req AS (SELECT {key} AS key, event_id AS request_id, epoch_us(ts) // 3000 AS ts_us, CASE user_id % 5 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END * 60000000 AS cost
  FROM events WHERE user_id % 5 <> 2),
seq AS (SELECT *, row_number() OVER w AS n, ts_us - lag(ts_us, 1, ts_us) OVER w AS gap FROM req WINDOW w AS (PARTITION BY key ORDER BY ts_us, request_id)),
run AS (SELECT key, request_id, n, least({cap}, {start}) AS before, least({cap}, {start}) - cost AS after, true AS allowed, cost FROM seq WHERE n = 1
  UNION ALL SELECT s.key, s.request_id, s.n, least({cap}, r.after + s.gap * {rate}),
    CASE WHEN least({cap}, r.after + s.gap * {rate}) >= s.cost THEN least({cap}, r.after + s.gap * {rate}) - s.cost ELSE least({cap}, r.after + s.gap * {rate}) END,
    least({cap}, r.after + s.gap * {rate}) >= s.cost, s.cost FROM run r JOIN seq s ON s.key = r.key AND s.n = r.n + 1)
SELECT key, request_id, allowed, round(CASE WHEN allowed THEN 0 ELSE (cost - after) / ({rate} * 1000000.0::DOUBLE) END, 6) AS retry_after FROM run"""


def _log_rule(case):
    return _l(f"SELECT 'app.log' AS source, line_no, severity, type FROM (SELECT line_no, unnest([{case}]) FROM logs) WHERE severity IS NOT NULL")


def _w(*words):
    return "(" + " OR ".join(f"contains(low, '{w}')" for w in words) + ")"


SQL = {
    "scan_files": "SELECT lang, 'txt' AS file_type, true AS supported, sum(strlen(text) + 1) AS bytes FROM documents GROUP BY lang",
    "source_summary": "SELECT true AS valid, sum(strlen(text) + 1) AS total_size, 0 AS unsupported_count, CAST(NULL AS VARCHAR) AS error_message FROM documents",
    "with_content_hash": "SELECT doc_id, sha256(text) AS content_hash, sha256(text)[1:16] AS short_hash FROM documents",
    "dedup_documents": """WITH known AS (SELECT sha256(text) AS h, min(id) AS id FROM (SELECT text, 'b' || item_id AS id FROM benchmark
          UNION ALL SELECT text, 'k' || d.doc_id FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE quality = 1) GROUP BY 1),
        inc AS (SELECT CAST(doc_id AS VARCHAR) AS path, sha256(text) AS content_hash FROM documents)
        SELECT path, content_hash, id AS existing_id, CASE WHEN id IS NOT NULL OR row_number() OVER (PARTITION BY content_hash ORDER BY path) > 1 THEN 'duplicate' ELSE 'new' END AS status
        FROM inc LEFT JOIN known ON h = content_hash""",
    "object_key": _r("SELECT id, 'raw-documents/' || strftime(upload_timestamp, '%Y/%m/%d') || '/' || hash || '/' || filename AS object_key FROM registry"),
    "register_documents": """SELECT 'doc-' || sha256(text)[1:16] AS id, sha256(text) AS hash, doc_id || '.txt' AS filename, TIMESTAMP '2024-02-03 04:05:06' AS upload_timestamp,
        'PENDING' AS status, 'raw-documents/2024/02/03/' || sha256(text) || '/' || doc_id || '.txt' AS s3_raw_path, 0 AS retry_count, 3 AS max_retries FROM documents""",
    "registry_lookup": _r("SELECT id, hash, status FROM registry WHERE o_orderkey IN (SELECT l_orderkey * 3 FROM lineitem)"),
    "list_documents": _r("SELECT id, status, upload_timestamp FROM registry ORDER BY upload_timestamp DESC, id LIMIT 50 OFFSET 25"),
    "flatten_blocks": fx.with_ctes(fx.SQL_BLOCKS, """SELECT document_id, 4 * (pos // 3 - pos // 27) + 1 + pos % 3 AS pos, block_type, html, caption,
          CASE WHEN k = 5 THEN CAST(to_json([[l, 'x'], [CAST(c AS VARCHAR)]]) AS VARCHAR) END AS rows FROM blocks WHERE document_id[-1:] <> '7' AND (pos // 3) % 9 <> 8
        UNION ALL SELECT document_id, 4 * (g - g // 9), 'Group', NULL, NULL, NULL FROM (SELECT DISTINCT document_id, pos // 3 AS g FROM blocks WHERE document_id[-1:] <> '7') WHERE g % 9 <> 8
        UNION ALL SELECT DISTINCT document_id, -1, 'invalid JSON', NULL, NULL, NULL FROM blocks WHERE document_id[-1:] = '7'"""),
    "read_sessions_files": _s("""SELECT session_id, user_id, title, created_at, updated_at, starred, (SELECT count(*) FROM conversations c WHERE c.conv_id = s.conv_id) AS n_messages,
        (SELECT md5(string_agg(text, '|' ORDER BY turn)) FROM conversations c WHERE c.conv_id = s.conv_id) AS contents FROM sessions s WHERE conv_id % 11 <> 3"""),
    "read_logs": _l("""SELECT 'app.log' AS source, CASE WHEN event_id * 3 < m THEN 2 WHEN event_id * 3 < 2 * m THEN 1 ELSE 0 END AS rotation, line_no,
        strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, md5(line) AS line_hash FROM logs, (SELECT max(event_id) AS m FROM events)"""),
    "write_chunks": fx.with_ctes(fx.SQL_PARTS, """SELECT c.document_id, c.clause_id AS chunk_id, c.title,
        (SELECT count(*) FROM content x WHERE x.document_id = c.document_id AND x.clause_id = c.clause_id) AS n_content,
        (SELECT count(*) FROM tree t WHERE t.document_id = c.document_id AND t.tree_parent_id = c.clause_id) AS n_children FROM clauses c"""),
    "event_log": """SELECT 'e' || event_id AS event_id, upper(event_type) AS event_type, 'd' || user_id AS document_id, ts, 'document.' || event_type AS routing_key, value FROM events""",
    "table_inventory": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count, {n} AS column_count FROM {t}" for t, n in (("documents", 5), ("events", 6), ("orders", 6), ("lineitem", 11), ("labels", 3))),
    "newest_sample": _r("SELECT id, upload_timestamp FROM registry ORDER BY upload_timestamp DESC, id LIMIT 10"),
    "clean_markdown": fx.with_ctes(SQL_MARKDOWN, "SELECT doc_id, md FROM clean"),
    "markdown_blocks": fx.with_ctes(SQL_MARKDOWN, f"""
        , heads AS (SELECT doc_id, token_no, length(regexp_extract(token, '^#+', 0)) AS n, {fx.sql_strip("regexp_replace(token, '^#+', '')")} AS t FROM toks WHERE starts_with(token, '#')),
        rest AS (SELECT * FROM toks WHERE NOT starts_with(token, '#') AND NOT starts_with(token, '|'))
        SELECT doc_id, token_no, 0 AS line_no, 'page_break' AS kind, CAST(NULL AS INT) AS level, '' AS text FROM heads WHERE n = 1
        UNION ALL SELECT doc_id, token_no, 0, 'table', NULL, token FROM toks WHERE starts_with(token, '|')
        UNION ALL SELECT doc_id, token_no, CASE WHEN n = 1 THEN 1 ELSE 0 END, 'heading', least(n, 9), t FROM heads WHERE t <> ''
        UNION ALL SELECT doc_id, token_no, 0, 'page_break', NULL, '' FROM rest WHERE regexp_matches(token, '^-{{3,}}$')
        UNION ALL SELECT doc_id, token_no, unnest(range(len(ls))), 'paragraph', NULL, unnest(ls) FROM (SELECT doc_id, token_no,
            list_filter(string_split(token, chr(10)), lambda x: {fx.sql_strip('x')} <> '') AS ls FROM rest WHERE NOT regexp_matches(token, '^-{{3,}}$'))"""),
    "markdown_table_cells": fx.with_ctes(SQL_MARKDOWN, f"""SELECT doc_id, token_no, row_no, col_no, {fx.sql_strip('cell')} AS cell FROM (
        SELECT doc_id, token_no, row_no, ncol, unnest(string_split(trim(r, '|'), '|')) AS cell, unnest(range(len(string_split(trim(r, '|'), '|')))) AS col_no FROM md_rows WHERE ncol > 0) WHERE col_no < ncol"""),
    "inline_runs": fx.with_ctes(SQL_MARKDOWN, f"""
        , paras AS (SELECT doc_id, token_no, unnest(range(len(ls))) AS line_no, unnest(ls) AS x FROM (SELECT doc_id, token_no,
            list_filter(string_split(token, chr(10)), lambda x: {fx.sql_strip('x')} <> '') AS ls FROM toks
            WHERE NOT starts_with(token, '#') AND NOT starts_with(token, '|') AND NOT regexp_matches(token, '^-{{3,}}$'))),
        cut AS (SELECT doc_id, token_no, line_no, unnest(rs) AS run, unnest(range(len(rs))) AS run_no FROM (SELECT *, list_filter(string_split(
            regexp_replace(x, '(?i)(\\*\\*.*?\\*\\*|<br\\s*/?>|<sub>.*?</sub>)', chr(1) || '\\1' || chr(1), 'g'), chr(1)), lambda r: r <> '') AS rs FROM paras))
        SELECT doc_id, token_no, line_no, run_no, CASE WHEN length(run) >= 4 AND run[1:2] = '**' AND run[-2:] = '**' THEN 'bold' WHEN lower(run) LIKE '<sub>%</sub>' THEN 'subscript'
            WHEN lower(run) LIKE '<br%>' THEN 'line_break' ELSE 'plain' END AS kind,
          CASE WHEN length(run) >= 4 AND run[1:2] = '**' AND run[-2:] = '**' THEN run[3:length(run)-2] WHEN lower(run) LIKE '<sub>%</sub>' THEN run[6:length(run)-6]
            WHEN lower(run) LIKE '<br%>' THEN '' ELSE run END AS text FROM cut"""),
    "extract_documents": """SELECT CAST(doc_id AS VARCHAR) AS document_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos,
          CASE WHEN starts_with(x, '#') THEN 'SectionHeader' ELSE 'Text' END AS block_type, md5(CASE WHEN starts_with(x, '#') THEN trim(ltrim(x, '#')) ELSE x END) AS html_hash
        FROM (SELECT doc_id, unnest(parts) AS x, unnest(range(len(parts))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)) WHERE trim(x) <> ''""",
    "active_documents": _r("SELECT id, status, (epoch_us(processing_completed) - epoch_us(processing_started)) / 1000000.0::DOUBLE AS processing_duration_seconds FROM registry WHERE status IN ('PENDING', 'PROCESSING')"),
    "failed_documents": _r("""SELECT r.id, 'stage' || l_linenumber AS failure_stage, l_linestatus = 'F' AS reviewed FROM registry r
        LEFT JOIN lineitem l ON l.l_orderkey = r.o_orderkey WHERE status = 'FAILED'"""),
    "processing_summary": _r("""SELECT id, status, upload_timestamp, (epoch_us(processing_completed) - epoch_us(upload_timestamp)) / 1000000.0::DOUBLE AS total_processing_seconds,
        page_count, clause_count, chunk_count, (SELECT count(DISTINCT l_partkey % 5) FROM lineitem WHERE l_orderkey * 2 = o_orderkey) AS actual_chunk_count FROM registry"""),
    "daily_statistics": _r("""SELECT CAST(upload_timestamp AS DATE) AS stat_date, count(*) AS total_documents, count(*) FILTER (status = 'COMPLETED') AS documents_completed,
        count(*) FILTER (status = 'FAILED') AS documents_failed, count(*) FILTER (status = 'PENDING') AS documents_pending,
        round(CAST(avg((epoch_us(processing_completed) - epoch_us(processing_started)) / 1000000.0::DOUBLE) AS DECIMAL(18, 6)), 2)::DOUBLE AS avg_total_time,
        sum(page_count) AS total_pages, sum(clause_count) AS total_clauses, sum(chunk_count) AS total_chunks FROM registry GROUP BY 1"""),
    "stage_times": """WITH t AS (SELECT user_id, CASE WHEN event_type IN ('click', 'view') THEN 'MARKER' ELSE 'GRAPH' END AS stage,
          min(ts) FILTER (event_type IN ('click', 'purchase')) AS a, max(ts) FILTER (event_type IN ('view', 'error')) AS b
          FROM events WHERE event_type <> 'signup' GROUP BY ALL)
        SELECT CAST(a AS DATE) AS stat_date, stage, round(CAST(avg((epoch_us(b) - epoch_us(a)) / 1000000.0::DOUBLE) AS DECIMAL(18, 6)), 2)::DOUBLE AS avg_time FROM t WHERE b >= a GROUP BY ALL""",
    "insert_if_absent": """SELECT c_custkey AS k, c_mktsegment AS v FROM customer UNION ALL
        SELECT o_custkey * 2, min(o_orderpriority) FROM orders WHERE o_custkey * 2 NOT IN (SELECT c_custkey FROM customer) GROUP BY 1""",
    "apply_status_updates": fx.with_ctes(SQL_REGISTRY + "," + SQL_UPDATES, """
        , u AS (SELECT id, arg_max(status, seq) AS status, max(ts) FILTER (status = 'PROCESSING') AS a, max(ts) FILTER (status IN ('COMPLETED', 'FAILED')) AS b,
          arg_max(error_message, seq) AS e, arg_max(marker_version, seq) AS m, arg_max(page_count, seq) AS p FROM updates GROUP BY id)
        SELECT r.id, coalesce(u.status, r.status) AS status, coalesce(a, processing_started) AS processing_started, coalesce(b, processing_completed) AS processing_completed,
          coalesce(e, error_message) AS error_message, coalesce(m, marker_version) AS marker_version, coalesce(p, page_count) AS page_count FROM registry r LEFT JOIN u ON r.id = u.id"""),
    "route_failures": _r("""SELECT id AS document_id, event_id AS seq, retry_count + n AS retry_count, CASE WHEN retry_count + n >= 3 THEN 'dead_letter' ELSE 'requeue' END AS action,
        CASE WHEN retry_count + n >= 3 THEN 'Max retries (3) exceeded: E' || props END AS error_message
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type = 'error') JOIN registry ON o_orderkey = user_id"""),
    "route_failures_registry": _r("""SELECT id, CASE WHEN n IS NULL THEN status WHEN retry_count + n >= 3 THEN 'FAILED' ELSE 'PENDING' END AS status, retry_count + coalesce(n, 0) AS retry_count,
        CASE WHEN retry_count + n >= 3 THEN 'Max retries (3) exceeded: E' || p ELSE error_message END AS error_message
        FROM registry LEFT JOIN (SELECT user_id, count(*) AS n, arg_max(props, event_id) AS p FROM events WHERE event_type = 'error' GROUP BY 1) ON o_orderkey = user_id"""),
    "manual_retry": _r("""SELECT a.id, coalesce(status = 'FAILED', false) AS queued, CASE WHEN status = 'FAILED' THEN 'PENDING' ELSE status END AS status,
        CASE WHEN status IS NULL THEN 'Document not found' WHEN status <> 'FAILED' THEN 'Can only retry failed documents' END AS error
        FROM (SELECT DISTINCT 'd' || (l_orderkey * 2) AS id FROM lineitem) a LEFT JOIN registry r ON a.id = r.id"""),
    "cascade_delete": _r("""SELECT 'c' || (l_partkey % 5) AS chunk_id, count(*) AS n FROM lineitem
        WHERE 'd' || (l_orderkey * 2) NOT IN (SELECT id FROM registry WHERE status = 'FAILED') GROUP BY 1"""),
    "ingestion_report": fx.with_ctes(_JOB, """SELECT job_id, count(*) AS total_files, count(outcome) AS processed_files, count(*) FILTER (outcome = 'success') AS successful_files,
        count(*) FILTER (outcome = 'failed') AS failed_files, count(*) FILTER (outcome = 'duplicate') AS duplicate_files,
        (epoch_us(max(ts)) + 2000000 - epoch_us(min(ts))) / 1000000.0::DOUBLE AS duration_seconds, round(100.0::DOUBLE * count(outcome) / count(*), 2) AS percentage,
        CASE WHEN count(outcome) = count(*) THEN 'COMPLETED' ELSE 'RUNNING' END AS status FROM files GROUP BY job_id"""),
    "ingestion_errors": fx.with_ctes(_JOB, """SELECT job_id, path, CASE outcome WHEN 'duplicate' THEN 'duplicate' ELSE 'processing_error' END AS error_type,
        CASE outcome WHEN 'duplicate' THEN 'Document already exists (duplicate hash)' ELSE error END AS error_message, true AS recoverable FROM files WHERE outcome IN ('failed', 'duplicate')"""),
    "list_sessions": _s("SELECT session_id, user_id, title, created_at, updated_at, starred FROM sessions"),
    "search_sessions": _s("""SELECT session_id, title FROM sessions s WHERE contains(lower(title), 'que la')
        OR EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = s.conv_id AND contains(lower(text), 'que la'))"""),
    "search_sessions_many": _s("""SELECT q.conv_id AS search_id, s.session_id, s.title FROM (SELECT conv_id, lower(upper(substring(text, 3, CAST(conv_id % 8 AS INT)))) AS q
          FROM conversations WHERE turn = 1) q JOIN sessions s ON contains(lower(title), q.q)
          OR EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = s.conv_id AND contains(lower(c.text), q.q))"""),
    "update_sessions": _s("""
        , ch AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'star' WHEN turn % 3 = 1 THEN 'rename' WHEN conv_id % 10 = 4 THEN 'delete' ELSE 'star' END AS action FROM conversations),
        net AS (SELECT conv_id, count(*) FILTER (action = 'star') AS stars, max(turn) FILTER (action = 'rename') AS t, count(*) FILTER (action = 'delete') AS gone FROM ch GROUP BY conv_id)
        SELECT session_id, user_id, coalesce('T' || t, title) AS title, created_at, coalesce(TIMESTAMP '2024-03-01' + to_seconds(t), updated_at) AS updated_at,
          CASE WHEN stars % 2 = 1 THEN NOT starred ELSE starred END AS starred FROM sessions JOIN net USING (conv_id) WHERE gone = 0"""),
    "session_titles": "SELECT 's' || conv_id AS session_id, arg_min(text, turn)[1:50] AS title FROM conversations WHERE role = 'user' GROUP BY conv_id",
    "list_users": """SELECT c_custkey AS user_id, c_name AS username, CASE WHEN c_custkey % 10 <> 0 THEN TIMESTAMP '2024-01-01' + to_seconds(c_custkey * 7 % 997) END AS created_at,
        (SELECT count(*) FROM customer) AS total_users FROM customer ORDER BY created_at DESC NULLS LAST, user_id LIMIT 50""",
    "username_conflicts": """SELECT o_orderkey AS signup_id, 'u' || (o_custkey * 3) AS username FROM orders WHERE o_custkey * 3 IN (SELECT c_custkey FROM customer)
        OR o_orderkey <> (SELECT min(o.o_orderkey) FROM orders o WHERE o.o_custkey = orders.o_custkey)""",
    "generated_file_lookup": _s("""SELECT 'm' || c.conv_id || '-' || turn AS message_id, CASE WHEN s.conv_id IS NOT NULL THEN '/files/' || s.conv_id || '.docx' END AS file_path, s.session_id
        FROM conversations c LEFT JOIN sessions s ON s.message_id = 'm' || c.conv_id || '-' || turn"""),
    "message_rules": """SELECT conv_id, turn, CASE WHEN c = '' THEN 'empty' WHEN length(c) > 4000 THEN 'too_long' ELSE 'ok' END AS verdict,
        CASE WHEN length(c) > 4000 THEN 'Message too long. Maximum 4000 characters allowed.' END AS error
        FROM (SELECT conv_id, turn, CASE WHEN turn = 4 THEN repeat(text, 9) ELSE text END AS c FROM conversations UNION ALL SELECT conv_id, -1, '' FROM conversations WHERE turn = 3)""",
    "parse_http_errors": _l("SELECT * FROM http_errors"),
    "classify_log_lines": _l("SELECT * FROM server WHERE severity IS NOT NULL"),
    "classify_log_lines_container": _l(f"""SELECT * FROM (SELECT 'app.log' AS source, line_no, CASE
        WHEN {_w('error', 'fatal', 'failed', 'exception', 'refused', 'timeout', 'denied')} THEN CASE WHEN {_w('no error', 'error=0', 'without error', 'error_action')} THEN NULL WHEN {_w('fatal', 'critical')} THEN 'critical' ELSE 'error' END
        WHEN {_w('warn', 'deprecated')} THEN 'warning' END AS severity, 'container' AS type, line[1:300] AS message FROM logs) WHERE severity IS NOT NULL"""),
    "classify_log_lines_container_tail": _l(f"""SELECT 'app.log' AS source, line_no, CASE WHEN {_w('fatal', 'critical')} THEN 'critical' ELSE 'error' END AS severity, 'container' AS type, line[1:500] AS message FROM logs
        WHERE {_w('error', 'exception', 'failed', 'fatal', 'critical')} AND NOT {_w('no error', 'error=0', 'errors: 0', 'without error')}"""),
    "classify_log_lines_server_tail": _l(f"""SELECT 'app.log' AS source, line_no, 'error' AS severity, 'log' AS type, line[1:500] AS message FROM logs
        WHERE {_w('error', 'exception', 'traceback', 'failed')} AND NOT {_w('no error', 'error=0')}"""),
    "classify_log_lines_health": _l(f"""SELECT * FROM (SELECT 'app.log' AS source, line_no, CASE WHEN contains(line, '" 5') AND contains(low, 'http/1.1"') THEN 'error' WHEN {_w('exception', 'traceback')} THEN 'error'
        WHEN {_w('deprecationwarning', 'futurewarning')} THEN 'warning' END AS severity, CASE WHEN contains(line, '" 5') THEN 'http_error' ELSE 'exception' END AS type, line[1:200] AS message FROM logs) WHERE severity IS NOT NULL"""),
    "tail_lines": _l("SELECT line_no, line FROM logs ORDER BY line_no DESC LIMIT 100"),
    "rank_errors": _l("""SELECT source, line_no, severity, message, (SELECT count(*) FROM all_errors) AS total,
        CASE severity WHEN 'critical' THEN 0 WHEN 'error' THEN 1 ELSE 2 END AS severity_rank FROM all_errors ORDER BY severity_rank, source, line_no LIMIT 100"""),
    "error_summary": _l("""SELECT count(*) AS total, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'error') AS error,
        count(*) FILTER (severity = 'warning') AS warning FROM all_errors"""),
    "dedupe_errors": _l("""SELECT source, line_no, severity, message FROM (SELECT source, line_no, severity, regexp_replace(message, '^[0-9: -]+ ', '') AS message FROM all_errors)
        QUALIFY row_number() OVER (PARTITION BY source, message[1:50] ORDER BY line_no) = 1 ORDER BY line_no LIMIT 20"""),
    "recent_samples": """SELECT metric, sample_id, rank, rank <= 30 AS shown FROM (SELECT event_type AS metric, event_id AS sample_id,
        row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rank FROM events) WHERE rank <= 60""",
    "run_metrics": "SELECT user_id AS run_id, count(*) AS calls, sum(CAST(value AS DECIMAL(12, 2)))::DOUBLE AS total_sec FROM events GROUP BY 1",
    "chapter_times": "SELECT user_id AS run_id, event_type AS chapter, sum(CAST(value AS DECIMAL(12, 2)))::DOUBLE AS seconds FROM events GROUP BY 1, 2",
    "rate_limit_replay": "WITH RECURSIVE " + _BUCKET.format(key="event_type", cap=70 * 60_000_000, start=60 * 60_000_000, rate=60).strip(),
    "rate_limit_split": "WITH RECURSIVE " + _BUCKET.format(key="'all'", cap=35 * 60_000_000, start=100 * 60_000_000, rate=30).strip(),
}
SQL["read_block_trees"] = SQL["flatten_blocks"]
