from pyspark.sql import functions as F

from clauseloom.operators import ops
from clauseloom.operators import registry as rg
from clauseloom.schemas import NESTED_CHUNKS
from clauseloom.streaming import events as ev
from clauseloom.streaming.graph import incremental_graph, read_gate
from clauseloom.streaming.run import drain, file_stream, write_batches


def batches(spark, path, frames):
    """Each frame one file, read one per batch in this order."""
    for df in frames:
        df.coalesce(1).write.mode("append").parquet(path)
    return file_stream(spark, path, "*.parquet", frames[0].schema, files_per_trigger=1)


def test_retries_count_across_batches(spark, tmp_path):
    schema = "document_id string, seq long, error string"
    frames = [spark.createDataFrame(r, schema) for r in ([("a", 1, "x"), ("b", 1, "x")], [("a", 2, "y")], [("a", 3, "z")])]
    out = drain(ev.retry_stream(batches(spark, str(tmp_path / "in"), frames)), "retry")
    got = sorted((r.document_id, r.seq, r.action) for r in out.collect())
    assert got == [("a", 1, "requeue"), ("a", 2, "requeue"), ("a", 3, "dead_letter"), ("b", 1, "requeue")]


def test_limits_equal_the_replay(spark, tmp_path):
    rows = [("k", i, i * 100_000, 1 + i % 5) for i in range(300)]
    schema = "key string, request_id long, ts_us long, cost int"
    frames = [spark.createDataFrame(rows[i : i + 100], schema) for i in (0, 100, 200)]
    live = drain(ev.rate_limit_stream(batches(spark, str(tmp_path / "in"), frames), idle_ms=None), "limit")
    key = lambda d: sorted((r.request_id, r.allowed, round(r.retry_after, 9)) for r in d.collect())
    assert key(live) == key(ops.rate_limit_replay(spark.createDataFrame(rows, schema)))


def test_states_equal_the_batch(spark, tmp_path):
    schema = "document_id string, t long, seq long, status string, error_message string"
    rows = [("a", 1, 1, "PENDING", None), ("a", 3, 3, "COMPLETED", None), ("a", 2, 2, "PROCESSING", "e"), ("b", 1, 4, "FAILED", "f")]
    frames = [spark.createDataFrame(rows[i : i + 2], schema).withColumn("ts", F.timestamp_seconds("t")) for i in (0, 2)]
    stream = batches(spark, str(tmp_path / "in"), frames)
    live = ev.latest_states(write_batches(ev.document_lifecycle(stream), "states", "update"))
    batch = rg.document_states(frames[0].union(frames[1]))
    assert sorted(map(str, live.collect())) == sorted(map(str, batch.select(*live.columns).collect()))


def test_state_of_documents_that_have_ended_goes(spark, tmp_path):
    schema = "document_id string, t long, seq long, status string, error_message string"
    hour, start = 3600, 10**6
    # Ten documents end in each of three batches, which lie days apart; one goes on and on.
    frames = [spark.createDataFrame(
        [(f"d{b}-{i}", start + b * 48 * hour + i, i, "COMPLETED", None) for i in range(10)] + [("open", start + b * 48 * hour, b, "PROCESSING", f"e{b}" if b < 2 else None)], schema
    ).withColumn("ts", F.timestamp_seconds("t")) for b in range(3)]
    stream = batches(spark, str(tmp_path / "in"), frames)
    kept = []
    live = ev.document_lifecycle(stream)
    query = live.writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.parquet(f"{tmp_path}/out/batch_id={n}")).option(
        "checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    for p in query.recentProgress:
        kept += [o["numRowsTotal"] for o in p.stateOperators]
    assert kept and max(kept) <= 21 and kept[-1] <= 11
    states = {r.id: r for r in ev.latest_states(spark.read.parquet(f"{tmp_path}/out")).collect()}
    assert len(states) == 31 and states["open"].error_message == "e1" and states["open"].status == "PROCESSING"


def test_duplicates_and_late_events(spark, tmp_path):
    schema = "document_id string, t long"
    frames = [spark.createDataFrame(r, schema).withColumn("ts", F.timestamp_seconds("t")) for r in (
        [("a", 100_000), ("a", 100_000)], [("a", 100_000), ("b", 200_000)], [("c", 200_001)], [("a", 100_001)])]
    out = drain(ev.exactly_once_events(batches(spark, str(tmp_path / "in"), frames)), "once")
    # The last event is more than an hour behind the watermark.
    assert sorted((r.document_id, r.t) for r in out.collect()) == [("a", 100_000), ("b", 200_000), ("c", 200_001)]


def test_uploads_are_registered_once(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    args = (str(tmp_path / "registry"), str(tmp_path / "checkpoint"))
    (folder / "a.txt").write_text("same")
    (folder / "b.txt").write_text("same")
    assert ev.ingest_uploads(ev.upload_stream(spark, str(folder)), *args).count() == 1
    (folder / "c.txt").write_text("same")
    (folder / "d.txt").write_text("new")
    events = ev.ingest_uploads(ev.upload_stream(spark, str(folder)), *args)
    assert sorted(r.document_id for r in events.collect()) == sorted({r.document_id for r in events.collect()})
    assert events.count() == 2


def nested(document, clause, parent=None, kind="paragraph"):
    return (
        f"{document}:{clause}", None, (document,), "t", None, (parent, [], 1), [(kind, f"text {clause}")], [], [], [], [], ([], ([],), []),
    )


def test_only_documents_that_pass_the_gate_reach_the_graph(spark, tmp_path):
    frames = [spark.createDataFrame(rows, NESTED_CHUNKS) for rows in (
        [nested("good", "1"), nested("bad", "1"), nested("bad", "2", kind="poem")],
        # The parent came in the batch before; that of the last one never does.
        [nested("good", "1.1", parent="1"), nested("lost", "7.1", parent="7")],
    )]
    path, root = str(tmp_path / "in"), str(tmp_path / "graph")
    nodes, edges = incremental_graph(batches(spark, path, frames), root, str(tmp_path / "checkpoint"), buckets=4)
    assert {r.uid for r in nodes.collect()} == {"document:good", "clause:good:1", "clause:good:1.1"}
    assert {(r.source_uid, r.target_uid) for r in edges.collect()} == {("document:good", "clause:good:1"), ("clause:good:1", "clause:good:1.1")}
    assert nodes.filter("label = 'Document'").first().total_clauses == 2
    told = {(r.batch_id, r.document_id): r.error_message for r in read_gate(spark, root).collect()}
    assert told == {(0, "good"): None, (0, "bad"): "Validation failed: 1 chunks invalid",
                    (1, "good"): None, (1, "lost"): "Validation failed: 1 chunks invalid"}


def test_a_batch_that_fails_the_gate_leaves_the_graph_as_it_was(spark, tmp_path):
    frames = [spark.createDataFrame(rows, NESTED_CHUNKS) for rows in ([nested("d", "1")], [nested("d", "2", kind="poem")])]
    nodes, _ = incremental_graph(batches(spark, str(tmp_path / "in"), frames), str(tmp_path / "graph"), str(tmp_path / "checkpoint"), buckets=2)
    assert {r.uid for r in nodes.collect()} == {"document:d", "clause:d:1"}
