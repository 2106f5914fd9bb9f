"""Document events as streams: uploads, routing, exactly-once, life cycle, retries, rates, limits, errors.

Event time is ``ts``; what arrives more than an hour late is dropped by the windowed operators.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from clauseloom.functions import ids
from clauseloom.operators import registry as rg
from clauseloom.operators.ops import KEY_BUCKET, TOKEN, classify_log_lines, parse_http_errors, spend
from clauseloom.plans.commits import BASE, Log, now
from clauseloom.plans.stage import stage
from clauseloom.streaming.run import for_each_commit

LATE = "1 hour"
_FILES = "path string, modificationTime timestamp, length long, content binary"


def upload_stream(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """New files with the hash of their bytes."""
    reader = spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", "true")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder).selectExpr(
        "path", r"regexp_extract(path, r'([^/]+)$', 1) AS filename", "length AS file_size", "modificationTime AS ts",
        f"{ids.content_hash('content')} AS content_hash",
    )


#: Hexadecimal digits of a hash that name its bucket in a compacted registry, and bits of the filter per hash.
REGISTRY_DIGITS, FILTER_BITS = 3, 16

#: Commits that a lookup reads besides the last compaction, at most.
REGISTRY_COMMITS = 32

_REGISTRY = "id string, hash string, filename string, file_size long, s3_raw_path string, ts timestamp, bucket int"
_FILTER = "bucket int, slot long, slots long, bits binary"
_HASH_BUCKET = f"CAST(conv(substring({{0}}, 1, {REGISTRY_DIGITS}), 16, 10) AS INT)"
#: Where a hash stands in the filter of its bucket, which is cut into bitmaps of 32,768 bits.
_HASH_BIT = f"CAST(pmod(CAST(conv(substring({{0}}, {REGISTRY_DIGITS + 1}, 12), 16, 10) AS BIGINT), slots * 32768) + 1 AS BIGINT)"


def compact_registry(spark: SparkSession, registry_path: str) -> int:
    """Lay all registered files out by the first digits of their hash, with a filter per bucket that tells which hashes are not in it."""
    log = Log(spark, registry_path)
    started, upto, folder = now(), log.last, log.fresh()
    rows, _ = log.read("files", _REGISTRY)
    laid = rows.repartitionByRange("bucket", "hash")
    laid.write.mode("error").partitionBy("bucket").parquet(f"{folder}/files")
    written = spark.read.schema(_REGISTRY).parquet(f"{folder}/files")
    slots = max(1, -(-written.count() * FILTER_BITS // (16 ** REGISTRY_DIGITS * 32768)))
    bits = written.selectExpr("bucket", "hash", f"{slots}L AS slots").selectExpr("bucket", "slots", f"{_HASH_BIT.format('hash')} AS bit")
    filters = bits.groupBy("bucket", F.expr("bitmap_bucket_number(bit)").alias("slot"), "slots").agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(bit))").alias("bits"))
    filters.select("bucket", "slot", "slots", "bits").write.mode("error").parquet(f"{folder}/filters")
    log.commit(folder, ["files", "filters"], started, kind=BASE, number=upto)
    return upto


def known_hashes(log: Log, hashes: DataFrame) -> DataFrame:
    """Those of ``hashes(content_hash)`` that are in the registry.

    Of the last compaction only the filters and the buckets that hold a likely hit are read; later commits are few and read whole.
    """
    spark = log.spark
    base, later, _ = log.parts("files")
    frames = [spark.read.schema(_REGISTRY).parquet(*later).selectExpr("hash AS content_hash")] if later else []
    if base:
        filters = spark.read.schema(_FILTER).parquet(log.parts("filters")[0])
        asked = hashes.select("content_hash").withColumn("slots", F.lit((filters.select("slots").first() or [1])[0]))
        asked = asked.selectExpr("content_hash", f"{_HASH_BUCKET.format('content_hash')} AS bucket", f"{_HASH_BIT.format('content_hash')} AS bit").selectExpr(
            "content_hash", "bucket", "bitmap_bucket_number(bit) AS slot", "bitmap_bit_position(bit) AS at")
        byte = "CAST(conv(hex(substring(bits, CAST(at DIV 8 AS INT) + 1, 1)), 16, 10) AS INT)"
        likely = stage(asked.join(filters, ["bucket", "slot"]).filter(f"shiftright({byte}, CAST(at % 8 AS INT)) % 2 = 1").select("content_hash", "bucket"), "likely")
        # At most one row per bucket comes to the driver.
        touched = [r.bucket for r in likely.select("bucket").distinct().collect()]
        stored = spark.read.schema(_REGISTRY).parquet(base).filter(F.col("bucket").isin(touched)).selectExpr("hash AS content_hash")
        frames.append(likely.select("content_hash").join(stored, "content_hash", "left_semi"))
    out = spark.createDataFrame([], "content_hash string")
    for frame in frames:
        out = out.unionByName(frame)
    return out


def ingest_uploads(uploads: DataFrame, registry_path: str, checkpoint: str) -> DataFrame:
    """Register each upload whose hash is not known yet and return DOCUMENT_UPLOADED events.

    The registry is a log of commits, one per batch of a stream: a batch that is repeated is in it already, and another stream, or
    one that starts over with a new checkpoint, adds to it. Known hashes are looked up in it (:func:`known_hashes`), so no state grows with the
    number of documents; it is compacted every ``REGISTRY_COMMITS`` batches.
    """
    spark = uploads.sparkSession

    def register(batch: DataFrame, batch_id: int, stream_id: str) -> None:
        log = Log(spark, registry_path)
        if log.holds(stream_id, batch_id):
            return
        started, folder = now(), log.fresh()
        first = stage(batch.groupBy("content_hash").agg(F.expr("min(struct(path, filename, file_size, ts))").alias("x")), "uploads")
        new = first.join(known_hashes(log, first), "content_hash", "left_anti").selectExpr("content_hash", "x.*")
        rows = rg.object_key(new, "content_hash", "filename", "ts").selectExpr(
            "concat('doc-', substring(content_hash, 1, 16)) AS id", "content_hash AS hash", "filename", "file_size",
            "object_key AS s3_raw_path", "ts", f"{_HASH_BUCKET.format('content_hash')} AS bucket",
        )
        rows.write.mode("error").parquet(f"{folder}/files")
        log.commit(folder, ["files"], started, writer=stream_id, batch=batch_id)
        if len(log.parts("files")[1]) >= REGISTRY_COMMITS:
            compact_registry(spark, registry_path)

    for_each_commit(uploads, register, checkpoint)
    rows, _ = Log(spark, registry_path).read("files", _REGISTRY)
    return rows.selectExpr(
        "concat(id, ':uploaded') AS event_id", "'DOCUMENT_UPLOADED' AS event_type", "id AS document_id", "ts",
        "'document.uploaded' AS routing_key", "s3_raw_path", "file_size", "hash AS content_hash",
    )


def route_events(events: DataFrame, event_type: str) -> DataFrame:
    """The events of one type. Each sink has its own query and checkpoint."""
    return events.filter(F.col("event_type") == event_type)


def exactly_once_events(events: DataFrame, keys: tuple[str, ...] = ("ts", "document_id"), late: str = LATE) -> DataFrame:
    """Each event once. Only the keys of the last hour are remembered."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


class _Lifecycle(StatefulProcessor):
    """The state of one document, kept until some time after it has ended.

    Rows come in batches in any order; each is reduced to the newest values before it meets the state.
    """

    def __init__(self, optional: list[str], kinds: list[str], retain_us: int):
        self.optional, self.kinds, self.retain_us = optional, kinds, retain_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Per optional field its value and the place (time, number) of the update that gave it.
        fields = ", ".join(f"v{i} {kind}, t{i} long, s{i} long" for i, kind in enumerate(self.kinds))
        self.state = handle.getValueState("state", ", ".join(["status string", "t long", "s long", "started long", "completed long", *([fields] if fields else [])]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = list(self.state.get()) if self.state.exists() else [None, None, None, None, None] + [None, None, None] * len(self.optional)

        def newer(at: tuple[int, int], t: int | None, s: int | None) -> bool:
            return t is None or at >= (t, s)

        for pdf in rows:
            pdf = pdf.sort_values(["t", "seq"])
            last = pdf.iloc[-1]
            if newer((int(last["t"]), int(last["seq"])), held[1], held[2]):
                held[:3] = [last["status"], int(last["t"]), int(last["seq"])]
            for place, ends in ((3, ("PROCESSING",)), (4, ("COMPLETED", "FAILED"))):
                times = pdf.loc[pdf["status"].isin(ends), "t"]
                if len(times):
                    held[place] = max(int(times.max()), held[place] if held[place] is not None else int(times.max()))
            for i, name in enumerate(self.optional):
                given = pdf.loc[pdf[name].notna()]
                if len(given) and newer((int(given["t"].iloc[-1]), int(given["seq"].iloc[-1])), held[6 + 3 * i], held[7 + 3 * i]):
                    value = given[name].iloc[-1]
                    held[5 + 3 * i : 8 + 3 * i] = [value.item() if hasattr(value, "item") else value, int(given["t"].iloc[-1]), int(given["seq"].iloc[-1])]
        self.state.update(tuple(held))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if held[0] in ("COMPLETED", "FAILED"):
            self.handle.registerTimer((held[1] + self.retain_us) // 1000)
        out = {"id": [key[0]], "status": [held[0]], "started": [held[3]], "completed": [held[4]]}
        out.update({name: [held[5 + 3 * i]] for i, name in enumerate(self.optional)})
        yield pd.DataFrame(out).astype({"started": "Int64", "completed": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # What the document came to is in the batches written.
        self.state.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def document_lifecycle(updates: DataFrame, late: str = LATE, retain_hours: float = 24) -> DataFrame:
    """The registry state of each document as its updates arrive (update mode); same rule as in batch.

    State of a document that has ended is dropped ``retain_hours`` of event time after its last update, unless another one came; one
    that comes later than that starts anew.
    """
    optional = [c for c in rg.OPTIONAL if c in updates.columns]
    kinds = [updates.schema[c].dataType.simpleString() for c in optional]
    rows = updates.withWatermark("ts", late).select("document_id", "ts", F.expr("unix_micros(ts) AS t"), F.col("seq").cast("long").alias("seq"), "status", *optional)
    typed = ", ".join(["id string", "status string", "started long", "completed long", *(f"{c} {k}" for c, k in zip(optional, kinds))])
    told = rows.groupBy("document_id").transformWithStateInPandas(
        statefulProcessor=_Lifecycle(optional, kinds, int(retain_hours * 3_600_000_000)), outputStructType=typed, outputMode="update", timeMode="EventTime",
    )
    return told.selectExpr("id", "status", "timestamp_micros(started) AS processing_started", "timestamp_micros(completed) AS processing_completed", *optional)


def latest_states(batches: DataFrame) -> DataFrame:
    """The newest row per document among the written batches of :func:`document_lifecycle`."""
    fields = [c for c in batches.columns if c not in ("id", "batch_id")]
    return batches.groupBy("id").agg(F.expr(f"max_by(struct({', '.join(fields)}), batch_id)").alias("x")).select("id", "x.*")


class _Retries(StatefulProcessor):
    """Counts the failures of one document across batches."""

    def __init__(self, max_retries: int):
        self.max_retries = max_retries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = self.count.get()[0] if self.count.exists() else 0
        pdf = pd.concat(rows).sort_values("seq")
        attempts = n + 1 + pd.Series(range(len(pdf)), index=pdf.index)
        dead = attempts >= self.max_retries
        self.count.update((int(n + len(pdf)),))
        yield pd.DataFrame({
            "document_id": key[0], "seq": pdf["seq"], "retry_count": attempts,
            "action": dead.map({True: "dead_letter", False: "requeue"}),
            "error_message": [f"Max retries ({self.max_retries}) exceeded: {e}" if d else None for e, d in zip(pdf["error"], dead)],
        })

    def close(self) -> None:
        pass


def retry_stream(failures: DataFrame, max_retries: int = 3) -> DataFrame:
    """Failures ``(document_id, seq, error)`` routed to ``requeue`` or ``dead_letter``, one count per document."""
    return failures.select("document_id", "seq", "error").groupBy("document_id").transformWithStateInPandas(
        statefulProcessor=_Retries(max_retries),
        outputStructType="document_id string, seq long, retry_count long, action string, error_message string",
        outputMode="append", timeMode="none",
    )


def processing_rate(events: DataFrame, status: str, seconds: str, size: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Events and mean seconds per window and status."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return (
        events.withWatermark("ts", LATE)
        .groupBy(window.alias("w"), F.col(status).alias("status"))
        .agg(F.count("*").alias("n"), F.sum(seconds).alias("total_seconds"))
        .selectExpr("w.start AS window_start", "status", "n", "total_seconds")
    )


class _Bucket(StatefulProcessor):
    """The token bucket of one key; an idle one is forgotten."""

    def __init__(self, bucket: dict, idle_ms: int | None):
        self.start, self.cap = bucket["start"] * TOKEN, bucket["cap"] * TOKEN
        self.rate, self.idle_ms = bucket["rate"], idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bucket = handle.getValueState("bucket", "tokens long, at long", self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(rows).sort_values(["ts_us", "request_id"])
        if self.bucket.exists():
            tokens, at = self.bucket.get()
        else:
            tokens, at = min(self.start, self.cap), int(pdf["ts_us"].iloc[0])
        allowed, wait = [], []
        for ts, cost in zip(pdf["ts_us"].tolist(), pdf["cost"].tolist()):
            need = int(cost) * TOKEN
            tokens, ok = spend(tokens, max(0, ts - at), need, self.rate, self.cap)
            at = max(at, ts)
            allowed.append(ok)
            wait.append(0.0 if ok else (need - tokens) / (self.rate * 1_000_000))
        self.bucket.update((int(tokens), int(at)))
        yield pd.DataFrame({"key": key[0], "request_id": pdf["request_id"], "allowed": allowed, "retry_after": wait})

    def close(self) -> None:
        pass


def rate_limit_stream(requests: DataFrame, bucket: dict = KEY_BUCKET, idle_ms: int | None = 600_000) -> DataFrame:
    """Live token buckets for requests ``(key, request_id, ts_us, cost)``.

    Idle time is processing time, so a replay of old requests keeps its buckets. Run it with a
    processing-time trigger: with an idle time set, a run over available input alone would keep checking
    for expiry and not end, so pass ``None`` for a replay.
    """
    return requests.select("key", "request_id", "ts_us", "cost").groupBy("key").transformWithStateInPandas(
        statefulProcessor=_Bucket(bucket, idle_ms),
        outputStructType="key string, request_id long, allowed boolean, retry_after double",
        outputMode="append", timeMode="ProcessingTime" if idle_ms else "none",
    )


def error_stream(lines: DataFrame, profile: str = "server", size: str = "5 minutes") -> DataFrame:
    """Errors in arriving lines ``(source, line_no, ts, line)``, counted per window, source and severity."""
    found = parse_http_errors(lines, ("ts",)).unionByName(classify_log_lines(lines, profile, ("ts",)))
    return (
        found.withWatermark("ts", LATE)
        .groupBy(F.window("ts", size).alias("w"), "source", "severity")
        .agg(F.count("*").alias("n"))
        .selectExpr("w.start AS window_start", "source", "severity", "n")
    )

