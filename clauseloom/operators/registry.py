"""The document registry: lookups, status changes, retries and reports as joins and aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.functions import ids
from clauseloom.plans.ordered import ordinal, segment_of


def with_content_hash(df: DataFrame, col: str) -> DataFrame:
    """Adds the SHA-256 of a text or binary column and its short form."""
    return df.selectExpr("*", f"{ids.content_hash(col)} AS content_hash", f"{ids.short_hash(col)} AS short_hash")


def dedup_documents(incoming: DataFrame, registry: DataFrame) -> DataFrame:
    """``incoming(path, content_hash, ...)`` with ``existing_id`` and ``status``: ``duplicate`` of a known
    document, ``duplicate`` of an earlier path in the batch, or ``new``.

    The first path per hash is a min that combines on the map side; many copies of one file meet their one
    hash row in a join that skew handling splits.
    """
    first = incoming.groupBy("content_hash").agg(F.min("path").alias("first_path"))
    known = registry.groupBy(F.col("hash").alias("content_hash")).agg(F.min("id").alias("existing_id"))
    verdict = first.join(known, "content_hash", "left")
    return incoming.join(verdict, "content_hash", "left").selectExpr(
        *incoming.columns, "existing_id",
        "CASE WHEN existing_id IS NOT NULL OR path <> first_path THEN 'duplicate' ELSE 'new' END AS status",
    )


def object_key(df: DataFrame, hash_col: str, name: str, ts: str, prefix: str = "raw-documents") -> DataFrame:
    return df.selectExpr("*", f"concat_ws('/', '{prefix}', date_format({ts}, 'yyyy/MM/dd'), {hash_col}, {name}) AS object_key")


def register_documents(new: DataFrame, ts: str) -> DataFrame:
    """Registry rows for ``new(content_hash, filename, ...)``. The id comes from the hash, so that a repeated
    run registers the same rows."""
    keyed = object_key(new, "content_hash", "filename", ts)
    return keyed.selectExpr(
        "concat('doc-', substring(content_hash, 1, 16)) AS id", "content_hash AS hash", "filename",
        f"{ts} AS upload_timestamp", "'PENDING' AS status", "object_key AS s3_raw_path", "0 AS retry_count", "3 AS max_retries",
    )


def registry_lookup(registry: DataFrame, keys: DataFrame, by: str = "id") -> DataFrame:
    """Registry rows of the asked ids or hashes."""
    return registry.join(keys.select(by).distinct(), by, "left_semi")


def list_documents(registry: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """One page, newest first."""
    page = registry.select("id", "filename", "status", "upload_timestamp", "hash")
    return page.orderBy(F.desc("upload_timestamp"), "id").offset(offset).limit(limit)


def _seconds(a: str, b: str) -> str:
    return f"(unix_micros({b}) - unix_micros({a})) / 1000000D"


def active_documents(registry: DataFrame) -> DataFrame:
    return registry.filter("status IN ('PENDING', 'PROCESSING')").selectExpr(
        "*", f"{_seconds('processing_started', 'processing_completed')} AS processing_duration_seconds"
    )


def failed_documents(registry: DataFrame, dead_letters: DataFrame) -> DataFrame:
    """Failed documents with their dead letters; several letters give several rows."""
    letters = dead_letters.selectExpr("document_id AS id", "failure_stage", "reviewed", "reviewed_by")
    return registry.filter("status = 'FAILED'").join(letters, "id", "left")


def processing_summary(registry: DataFrame, chunks: DataFrame) -> DataFrame:
    counted = chunks.groupBy(F.col("document_id").alias("id")).agg(F.count_distinct("chunk_id").alias("n"))
    return registry.join(counted, "id", "left").selectExpr(
        "id", "filename", "status", "upload_timestamp", "processing_completed",
        f"{_seconds('upload_timestamp', 'processing_completed')} AS total_processing_seconds",
        "page_count", "clause_count", "chunk_count", "coalesce(n, 0) AS actual_chunk_count",
    )


def daily_statistics(registry: DataFrame) -> DataFrame:
    """Counts by status, mean total seconds and content totals per upload day."""
    dated = registry.selectExpr(
        "to_date(upload_timestamp) AS stat_date", "status", "page_count", "clause_count", "chunk_count",
        f"{_seconds('processing_started', 'processing_completed')} AS secs",
    )
    return dated.groupBy("stat_date").agg(
        F.count("*").alias("total_documents"),
        F.expr("count_if(status = 'COMPLETED')").alias("documents_completed"),
        F.expr("count_if(status = 'FAILED')").alias("documents_failed"),
        F.expr("count_if(status = 'PENDING')").alias("documents_pending"),
        F.expr("CAST(avg(secs) AS DECIMAL(10, 2))").alias("avg_total_time"),
        F.expr("coalesce(sum(page_count), 0)").alias("total_pages"),
        F.expr("coalesce(sum(clause_count), 0)").alias("total_clauses"),
        F.expr("coalesce(sum(chunk_count), 0)").alias("total_chunks"),
    )


def stage_times(events: DataFrame) -> DataFrame:
    """Mean seconds of each processing stage per day, from the PROCESSING_x and COMPLETED_x events of a document."""
    per = (
        events.selectExpr("document_id", "ts", "regexp_extract(status, '^(PROCESSING|COMPLETED)_(.+)$', 1) AS edge",
                          "regexp_extract(status, '^(PROCESSING|COMPLETED)_(.+)$', 2) AS stage")
        .filter("stage <> ''")
        .groupBy("document_id", "stage")
        .agg(F.expr("min(ts) FILTER (WHERE edge = 'PROCESSING')").alias("a"), F.expr("max(ts) FILTER (WHERE edge = 'COMPLETED')").alias("b"))
        .filter("b >= a")
    )
    return per.groupBy(F.expr("to_date(a)").alias("stat_date"), "stage").agg(
        F.expr(f"CAST(avg({_seconds('a', 'b')}) AS DECIMAL(10, 2))").alias("avg_time")
    )


def insert_if_absent(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The table with the rows whose key it lacks; among equal keys in the batch the smallest row."""
    others = [c for c in table.columns if c != key]
    one = rows.groupBy(key).agg(F.expr(f"min(struct({', '.join(others)}))").alias("x")).selectExpr(key, "x.*")
    return table.unionByName(one.join(table.select(key), key, "left_anti"))


OPTIONAL = ("error_message", "marker_version", "s3_json_path", "page_count")


def document_states(updates: DataFrame) -> DataFrame:
    """State of each document after ``updates(document_id, ts, seq, status, optional fields)``.

    The latest status wins; the start is set at PROCESSING, the end at COMPLETED or FAILED; an optional
    field keeps its value unless a later update gives one. A plain aggregate, so it combines on the map
    side and runs the same on a stream.
    """
    at = "struct(ts, seq)"
    return updates.groupBy(F.col("document_id").alias("id")).agg(
        F.expr(f"max_by(status, {at})").alias("status"),
        F.expr("max(ts) FILTER (WHERE status = 'PROCESSING')").alias("processing_started"),
        F.expr("max(ts) FILTER (WHERE status IN ('COMPLETED', 'FAILED'))").alias("processing_completed"),
        *[F.expr(f"max_by({c}, {at}) FILTER (WHERE {c} IS NOT NULL)").alias(c) for c in OPTIONAL if c in updates.columns],
    )


def apply_status_updates(registry: DataFrame, updates: DataFrame) -> DataFrame:
    """The registry after status updates, see :func:`document_states`."""
    states = document_states(updates)
    new = states.select("id", *[F.col(c).alias(f"_{c}") for c in states.columns if c != "id"])
    return registry.join(new, "id", "left").selectExpr(
        *[f"coalesce(_{c}, {c}) AS {c}" if c in states.columns and c != "id" else c for c in registry.columns]
    )


def route_failures(registry: DataFrame, failures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Failures ``(document_id, seq, error)`` counted against the retries of their document.

    Returns one routed row per failure (``requeue`` or ``dead_letter``) and the registry afterwards.
    Failures of unknown documents are ignored.
    """
    base = registry.selectExpr("id", "retry_count AS had", "max_retries AS most")
    known = failures.join(base, F.expr("document_id = id"))
    attempt = ordinal(known.selectExpr("*", f"{segment_of('seq')} AS _seg"), ["document_id"], ["_seg"], ["seq"], "n")
    routed = attempt.selectExpr(
        "document_id", "seq", "had + n AS retry_count",
        "CASE WHEN had + n >= most THEN 'dead_letter' ELSE 'requeue' END AS action",
        "CASE WHEN had + n >= most THEN concat('Max retries (', most, ') exceeded: ', error) END AS error_message",
    )
    summary = known.groupBy("id").agg(F.count("*").alias("_n"), F.expr("max_by(error, seq)").alias("_error"))
    after = registry.join(summary, "id", "left").selectExpr(
        *[
            {
                "retry_count": "CAST(retry_count + coalesce(_n, 0) AS INT) AS retry_count",
                "status": "CASE WHEN _n IS NULL THEN status WHEN retry_count + _n >= max_retries THEN 'FAILED' ELSE 'PENDING' END AS status",
                "error_message": "CASE WHEN _n IS NOT NULL AND retry_count + _n >= max_retries"
                " THEN concat('Max retries (', max_retries, ') exceeded: ', _error) ELSE error_message END AS error_message",
            }.get(c, c)
            for c in registry.columns
        ]
    )
    return routed, after


def manual_retry(registry: DataFrame, asked: DataFrame) -> DataFrame:
    """Per asked id whether it goes back to PENDING, or why not."""
    found = registry.selectExpr("id", "status AS _status")
    # The messages.
    return asked.select("id").distinct().join(found, "id", "left").selectExpr(
        "id", "coalesce(_status = 'FAILED', false) AS queued",
        "CASE WHEN _status = 'FAILED' THEN 'PENDING' ELSE _status END AS status",
        "CASE WHEN _status IS NULL THEN 'Document not found' WHEN _status <> 'FAILED' THEN 'Can only retry failed documents' END AS error",
    )


def cascade_delete(tables: dict[str, tuple[DataFrame, str]], deleted: DataFrame) -> dict[str, DataFrame]:
    """Each dependent table ``name: (rows, key column)`` without the rows of the deleted ids."""
    gone = deleted.selectExpr("id AS _id").distinct()
    return {name: df.join(gone, F.expr(f"{key} = _id"), "left_anti") for name, (df, key) in tables.items()}


def ingestion_report(files: DataFrame) -> DataFrame:
    """Per job ``(job_id, path, outcome, error, started, ended)``: counts, progress and duration.

    A job completes even when files failed. ``outcome`` is success, failed, duplicate or null (not reached).
    """
    return files.groupBy("job_id").agg(
        F.count("*").alias("total_files"),
        F.expr("count_if(outcome IS NOT NULL)").alias("processed_files"),
        F.expr("count_if(outcome = 'success')").alias("successful_files"),
        F.expr("count_if(outcome = 'failed')").alias("failed_files"),
        F.expr("count_if(outcome = 'duplicate')").alias("duplicate_files"),
        F.expr("(unix_micros(max(ended)) - unix_micros(min(started))) / 1000000D").alias("duration_seconds"),
    ).selectExpr(
        "*", "round(100D * processed_files / total_files, 2) AS percentage",
        "CASE WHEN processed_files = total_files THEN 'COMPLETED' ELSE 'RUNNING' END AS status",
    )


def ingestion_errors(files: DataFrame) -> DataFrame:
    # The error types and the message of a duplicate.
    return files.filter("outcome IN ('failed', 'duplicate')").selectExpr(
        "job_id", "path",
        "CASE outcome WHEN 'duplicate' THEN 'duplicate' ELSE 'processing_error' END AS error_type",
        "CASE outcome WHEN 'duplicate' THEN 'Document already exists (duplicate hash)' ELSE error END AS error_message",
        "true AS recoverable",
    )


def table_inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and columns of each table."""
    rows = [
        df.agg(F.count("*").alias("row_count")).selectExpr(f"'{name}' AS table_name", "row_count", f"{len(df.columns)} AS column_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, rows)


def newest_sample(table: DataFrame, ts: str, key: str, n: int) -> DataFrame:
    return table.orderBy(F.desc(ts), key).limit(n)
