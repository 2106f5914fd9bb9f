"""Streams run over the given tables until all input is processed."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from itertools import count

from pyspark.sql import functions as F

from clauseloom.catalog import fixtures as fx
from clauseloom.catalog import graph as cg
from clauseloom.catalog import records as rc
from clauseloom.operators import graph as gr
from clauseloom.operators import ops
from clauseloom.operators import quality as ql
from clauseloom.plans.stage import CODEC, fresh_path, passing
from clauseloom.streaming import events as ev
from clauseloom.streaming import graph as sg
from clauseloom.streaming.graph import incremental_graph
from clauseloom.streaming.run import drain, file_stream, write_batches


def event_stream(spark, sf):
    """``events`` as a stream; the test data has timestamps without zone, which a watermark refuses."""
    schema = fx.read(spark, sf, "events").schema
    return file_stream(spark, sf, "events.parquet", schema).withColumn("ts", F.expr("CAST(ts AS TIMESTAMP)"))


def upload_stream(spark, sf):
    path = rc.written_texts(spark, sf)
    ups = ev.upload_stream(spark, path, files_per_trigger=2)
    events = ev.ingest_uploads(ups, fresh_path(spark, "registry"), fresh_path(spark, "uploads"))
    return events.agg(F.expr("count(*) = count(DISTINCT content_hash)").alias("all_distinct"), F.sum("file_size").alias("bytes"))


def route_events(spark, sf):
    routed = [drain(ev.route_events(event_stream(spark, sf), t), t) for t in ("error", "purchase")]
    return routed[0].unionByName(routed[1]).select("event_id", "event_type")


def exactly_once_events(spark, sf):
    """Every event twice in the stream."""
    twice = event_stream(spark, sf).selectExpr("explode(sequence(1, 2)) AS copy", "event_id", "user_id AS document_id", "ts")
    return drain(ev.exactly_once_events(twice), "once").select("event_id", "document_id")


def document_lifecycle(spark, sf):
    updates = event_stream(spark, sf).selectExpr(
        "concat('d', user_id) AS document_id", "ts", "event_id AS seq",
        "CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'click' THEN 'PROCESSING' WHEN 'view' THEN 'COMPLETED_MARKER' WHEN 'purchase' THEN 'COMPLETED' ELSE 'FAILED' END AS status",
        "CASE WHEN event_type = 'error' THEN props END AS error_message")
    return ev.latest_states(write_batches(ev.document_lifecycle(updates), "states", "update"))


def retry_stream(spark, sf):
    failures = event_stream(spark, sf).filter("event_type = 'error'").selectExpr(
        "concat('d', user_id) AS document_id", "event_id AS seq", "concat('E', props) AS error")
    return drain(ev.retry_stream(failures), "retries")


def _rate(slide):
    def run(spark, sf):
        events = event_stream(spark, sf).selectExpr("ts", "event_type", "CAST(value AS DECIMAL(12, 2)) AS seconds")
        out = write_batches(ev.processing_rate(events, "event_type", "seconds", slide=slide), "rate", "update")
        # The newest batch of a window holds its count.
        last = out.groupBy("window_start", "status").agg(F.expr("max_by(struct(n, total_seconds), batch_id)").alias("x"))
        return last.selectExpr("window_start", "status", "x.n", "CAST(x.total_seconds AS DOUBLE) AS total_seconds")

    return run


def rate_limit_stream(spark, sf):
    requests = event_stream(spark, sf).selectExpr(
        "event_type AS key", "event_id AS request_id", "CAST(floor(unix_micros(ts) / 3000) AS BIGINT) AS ts_us",
        "CASE user_id % 5 WHEN 0 THEN '/api/v2/test-plan' WHEN 1 THEN '/ws/chat' WHEN 2 THEN '/health' ELSE '/api/chat' END AS path")
    out = drain(ev.rate_limit_stream(ops.request_costs(requests), idle_ms=None), "limits")
    return out.withColumn("retry_after", F.expr("round(retry_after, 6)"))


def error_stream(spark, sf):
    lines = event_stream(spark, sf).selectExpr(
        "'app' AS source", "event_id AS line_no", "ts",
        """CASE event_type WHEN 'error' THEN concat('Fatal: refused ', props) WHEN 'click' THEN concat('Warning: old ', props)
             WHEN 'view' THEN concat('"GET /api/x HTTP/1.1" ', CASE event_id % 3 WHEN 0 THEN 200 WHEN 1 THEN 404 ELSE 500 END) ELSE 'fine' END AS line""")
    out = write_batches(ev.error_stream(lines), "errors", "update")
    last = out.groupBy("window_start", "source", "severity").agg(F.expr("max_by(n, batch_id)").alias("n"))
    return last


def _batches(spark, chunks, by):
    """A chunk table as a stream of three batches or more into the graph, each of as many files as a third of the tasks."""
    path = fresh_path(spark, "chunk-stream")
    with passing():
        rows = chunks() if callable(chunks) else chunks
        rows.repartition(max(3, int(spark.conf.get("spark.sql.shuffle.partitions"))), F.expr(by)).write.option("compression", CODEC).parquet(path)
    written = spark.read.parquet(path)
    stream = file_stream(spark, path, "*.parquet", written.schema, files_per_trigger=max(1, len(written.inputFiles()) // 3))
    return incremental_graph(stream, fresh_path(spark, "graph"), fresh_path(spark, "graph-checkpoint"))


def _incremental(spark, sf):
    """Documents are split across batches."""
    return _batches(spark, lambda: cg.chunks(spark, sf), "chunk_id")


def _gated(spark, sf):
    """Both chunk forms through the gate, each document in one batch."""
    return _batches(spark, lambda: cg.nested_chunks(spark, sf), ql.DOCUMENT)


def incremental_documents(spark, sf):
    nodes, _ = _incremental(spark, sf)
    return nodes.filter("label = 'Document'").select("uid", "total_clauses", "total_tables", "total_figures")


def incremental_edges(spark, sf):
    return _incremental(spark, sf)[1].select("source_uid", "rel_type", "target_uid")


#: Which documents come in which commit, by the number in their id; some come twice.
_SENT = {1: "d % 3 = 0", 2: "d % 3 = 1 OR d % 6 = 0", 3: "d % 3 = 2 OR d % 4 = 0"}
_START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def _clock():
    """A clock that is read when a commit starts and when it is complete, half an hour each."""
    ticks = count()
    return lambda: _START + timedelta(minutes=30 * next(ticks))


def _graph_log(spark, sf, steps):
    """A graph of commits: the numbered batches of documents, and jobs in between."""
    root, clock = fresh_path(spark, "graph"), _clock()
    with passing():
        rows = cg.uniform(spark, sf).withColumn("d", F.expr("CAST(substring(document_id, 4) AS BIGINT)"))
        for step in steps:
            if callable(step):
                step(root, rows, clock)
            else:
                sg.append_graph(spark, root, rows.filter(_SENT[step]).drop("d"), clock=clock)
    return root


_AUDIT = ["date_format(created_at, 'yyyy-MM-dd HH:mm') AS created_at", "date_format(updated_at, 'yyyy-MM-dd HH:mm') AS updated_at", "version"]


def graph_as_of(spark, sf):
    """The nodes as they were after the second of three commits, asked for by time."""
    nodes, _ = sg.read_graph(spark, _graph_log(spark, sf, [1, 2, 3]), _START + timedelta(minutes=100))
    return nodes.selectExpr("label", "uid", "document_id", *_AUDIT)


def graph_as_of_edges(spark, sf):
    _, edges = sg.read_graph(spark, _graph_log(spark, sf, [1, 2, 3]), 2)
    return edges.selectExpr("source_uid", "rel_type", "target_uid", *_AUDIT)


def graph_compacted(spark, sf):
    """Compaction between commits, deletion of the toxic documents, every second of which comes back, and a compaction at the end."""
    toxic = fx.read(spark, sf, "labels").filter("toxic = 1").selectExpr("concat('doc', doc_id) AS document_id")

    def delete(root, rows, clock):
        sg.delete_documents(spark, root, toxic, clock)

    def again(root, rows, clock):
        sg.append_graph(spark, root, rows.filter("d % 2 = 0").join(toxic, "document_id", "left_semi").drop("d"), clock=clock)

    def compact(root, rows, clock):
        sg.compact(spark, root, buckets=4)

    nodes, edges = sg.read_graph(spark, _graph_log(spark, sf, [1, 2, compact, 3, delete, again, compact]))
    return nodes.selectExpr("label AS kind", "uid", *_AUDIT).unionByName(
        edges.selectExpr("rel_type AS kind", "concat(source_uid, ' > ', target_uid) AS uid", *_AUDIT))


def graph_commits(spark, sf):
    """One transaction per document and commit."""
    told = sg.read_transactions(spark, _graph_log(spark, sf, [1, 2, 3]))
    times = [f"date_format({c}, 'yyyy-MM-dd HH:mm') AS {c}" for c in ("started_at", "completed_at")]
    return told.selectExpr("transaction_id", "document_id", "status", "nodes_sent", "nodes_stored", "edges_sent", "edges_stored", "number", *times)


def _tick(expr):
    return f"strftime(TIMESTAMP '2024-01-01' + to_minutes(CAST({expr} AS INT)), '%Y-%m-%d %H:%M')"


_SENT_SQL = " OR ".join(f"(k = {k} AND ({when}))" for k, when in _SENT.items())
#: What each commit sends: nodes and edges with the commit's number; deleted documents keep only what comes after.
_COMMITS_SQL = f"""
, ks AS (SELECT document_id, k FROM (SELECT DISTINCT document_id, CAST(substring(document_id, 4) AS BIGINT) AS d FROM clauses), range(1, 4) AS t(k)
   WHERE {_SENT_SQL}),
sent_all AS (SELECT source_uid, rel_type, target_uid, document_id FROM e_contains UNION ALL SELECT source_uid, rel_type, target_uid, document_id FROM e_req
   UNION ALL SELECT source_uid, rel_type, target_uid, document_id FROM e_content UNION ALL SELECT source_uid, rel_type, target_uid, document_id FROM e_ref
   WHERE rel_type = 'REFERENCES' UNION ALL SELECT {cg._CL}, 'REFERS_TO', 'clause:' || document_id || ':' || ref, document_id FROM ref_c),
of_document AS (SELECT DISTINCT label, uid, document_id FROM sent_n WHERE document_id IN (SELECT document_id FROM clauses)),
of_any AS (SELECT label, uid, document_id, document_id AS sender FROM of_document
   UNION ALL SELECT DISTINCT 'Standard', uid, CAST(NULL AS VARCHAR), document_id FROM std),
edges_of AS (SELECT DISTINCT source_uid, rel_type, target_uid, document_id FROM sent_e
   WHERE source_uid IN (SELECT uid FROM nodes) AND target_uid IN (SELECT uid FROM nodes))"""
_AUDIT_SQL = f"{_tick('60 * (min(k) - 1)')} AS created_at, {_tick('60 * (max(k) - 1)')} AS updated_at, CAST(count(DISTINCT k) AS BIGINT) AS version"


QUERIES = {
    "graph_as_of": graph_as_of,
    "graph_as_of_edges": graph_as_of_edges,
    "graph_compacted": graph_compacted,
    "graph_commits": graph_commits,
    "upload_stream": upload_stream,
    "route_events": route_events,
    "exactly_once_events": exactly_once_events,
    "document_lifecycle": document_lifecycle,
    "retry_stream": retry_stream,
    "processing_rate": _rate(None),
    "processing_rate_sliding": _rate("1 minute"),
    "rate_limit_stream": rate_limit_stream,
    "error_stream": error_stream,
    "incremental_graph": lambda s, d: gr.graph_statistics(*_incremental(s, d)),
    "incremental_documents": incremental_documents,
    "incremental_edges": incremental_edges,
    "gated_nodes": lambda s, d: _gated(s, d)[0].select("label", "uid", "document_id"),
    "gated_edges": lambda s, d: _gated(s, d)[1].select("source_uid", "rel_type", "target_uid"),
}

SQL = {
    "graph_as_of": cg._g(f"""{_COMMITS_SQL} SELECT label, uid, any_value(o.document_id) AS document_id, {_AUDIT_SQL}
        FROM of_any o JOIN ks ON ks.document_id = o.sender WHERE k <= 2 GROUP BY label, uid"""),
    "graph_as_of_edges": cg._g(f"""{_COMMITS_SQL} SELECT source_uid, rel_type, target_uid, {_AUDIT_SQL}
        FROM edges_of JOIN ks USING (document_id) WHERE k <= 2 GROUP BY source_uid, rel_type, target_uid"""),
    "graph_compacted": cg._g(f"""{_COMMITS_SQL},
        toxic AS (SELECT 'doc' || doc_id AS document_id, doc_id % 2 = 0 AS back FROM labels WHERE toxic = 1),
        again AS (SELECT DISTINCT document_id, 5 AS k FROM clauses WHERE document_id IN (SELECT document_id FROM toxic WHERE back)),
        kept AS (SELECT * FROM ks WHERE document_id NOT IN (SELECT document_id FROM toxic) UNION ALL SELECT * FROM again),
        every AS (SELECT * FROM ks UNION ALL SELECT * FROM again)
        SELECT label AS kind, uid, {_AUDIT_SQL} FROM of_document JOIN kept USING (document_id) GROUP BY label, uid
        UNION ALL SELECT 'Standard', uid, {_AUDIT_SQL} FROM (SELECT DISTINCT uid, document_id FROM std) JOIN every USING (document_id) GROUP BY uid
        UNION ALL SELECT rel_type, source_uid || ' > ' || target_uid, {_AUDIT_SQL} FROM edges_of JOIN kept USING (document_id)
        GROUP BY source_uid, rel_type, target_uid"""),
    "graph_commits": cg._g(f"""{_COMMITS_SQL},
        n AS (SELECT document_id, count(*) AS c, count(DISTINCT (label, uid)) AS d FROM sent_n WHERE document_id IS NOT NULL GROUP BY 1),
        e AS (SELECT document_id, count(*) AS c, count(DISTINCT (source_uid, rel_type, target_uid)) AS d FROM sent_all GROUP BY 1)
        SELECT sha256(document_id || '::' || k)[1:16] AS transaction_id, document_id, 'completed' AS status, n.c AS nodes_sent, n.d AS nodes_stored,
          e.c AS edges_sent, e.d AS edges_stored, k AS number, {_tick('60 * (k - 1)')} AS started_at, {_tick('60 * (k - 1) + 30')} AS completed_at
        FROM ks JOIN n USING (document_id) JOIN e USING (document_id)"""),
    "upload_stream": "SELECT true AS all_distinct, sum(strlen(text) + 1) AS bytes FROM documents",
    "route_events": "SELECT event_id, event_type FROM events WHERE event_type IN ('error', 'purchase')",
    "exactly_once_events": "SELECT min(event_id) AS event_id, user_id AS document_id FROM events GROUP BY ts, user_id",
    "document_lifecycle": """SELECT 'd' || user_id AS id, arg_max(CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'click' THEN 'PROCESSING' WHEN 'view' THEN 'COMPLETED_MARKER'
          WHEN 'purchase' THEN 'COMPLETED' ELSE 'FAILED' END, event_id) AS status, max(ts) FILTER (event_type = 'click') AS processing_started,
        max(ts) FILTER (event_type IN ('purchase', 'error')) AS processing_completed, arg_max(CASE WHEN event_type = 'error' THEN props END, event_id) AS error_message FROM events GROUP BY user_id""",
    "retry_stream": """SELECT 'd' || user_id AS document_id, event_id AS seq, n AS retry_count, CASE WHEN n >= 3 THEN 'dead_letter' ELSE 'requeue' END AS action,
        CASE WHEN n >= 3 THEN 'Max retries (3) exceeded: E' || props END AS error_message
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type = 'error')""",
    "processing_rate": """SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS window_start, event_type AS status, count(*) AS n, sum(CAST(value AS DECIMAL(12, 2)))::DOUBLE AS total_seconds
        FROM events GROUP BY ALL""",
    "processing_rate_sliding": """SELECT window_start, event_type AS status, count(*) AS n, sum(CAST(value AS DECIMAL(12, 2)))::DOUBLE AS total_seconds
        FROM (SELECT *, unnest([date_trunc('minute', ts), date_trunc('minute', ts) - INTERVAL 1 MINUTE, date_trunc('minute', ts) - INTERVAL 2 MINUTES,
          date_trunc('minute', ts) - INTERVAL 3 MINUTES, date_trunc('minute', ts) - INTERVAL 4 MINUTES]) AS window_start FROM events) GROUP BY ALL""",
    "rate_limit_stream": rc.SQL["rate_limit_replay"],
    "error_stream": """SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS window_start, 'app' AS source, CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'warning'
          ELSE CASE WHEN event_id % 3 = 1 THEN 'error' ELSE 'critical' END END AS severity, count(*) AS n FROM events
        WHERE event_type IN ('error', 'click') OR (event_type = 'view' AND event_id % 3 <> 0) GROUP BY ALL""",
    "incremental_documents": cg._g("""SELECT 'document:' || document_id AS uid, count(*) FILTER (label = 'Clause') AS total_clauses,
        count(*) FILTER (label = 'Table') AS total_tables, count(*) FILTER (label = 'Figure') AS total_figures
        FROM nodes WHERE document_id IN (SELECT document_id FROM clauses) GROUP BY document_id"""),
    "incremental_edges": cg._g("SELECT source_uid, rel_type, target_uid FROM edges"),
    "gated_nodes": cg._g("""SELECT DISTINCT n.label, n.uid, n.document_id FROM sent_n n JOIN gate g USING (document_id) WHERE g.failed = 0
        UNION ALL SELECT DISTINCT 'Standard', s.uid, CAST(NULL AS VARCHAR) FROM std s JOIN gate g USING (document_id) WHERE g.failed = 0"""),
    "gated_edges": cg._g("""SELECT DISTINCT source_uid, rel_type, target_uid FROM sent_e JOIN gate USING (document_id)
        WHERE failed = 0 AND source_uid IN (SELECT uid FROM nodes) AND target_uid IN (SELECT uid FROM nodes)"""),
    "incremental_graph": cg._g("""
        , seen AS (SELECT * FROM nodes WHERE label <> 'Document' OR document_id IN (SELECT document_id FROM clauses))
        """ + cg._STATS.format(n="seen", e="edges")),
}
