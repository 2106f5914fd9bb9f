import json
import random

import pytest
from pyspark.sql import functions as F

from clauseloom.operators import ops
from clauseloom.operators import registry as rg
from clauseloom.operators import sessions as ss
from clauseloom.sources import files as fl


@pytest.fixture()
def folder(tmp_path):
    for name in ("document1.pdf", "document2.pdf", "readme.txt", "notes.MD", "report.docx", "image.jpg", "script.py", "sub/nested.pdf", "sub/nested.txt"):
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("# Title\ncontent of " + name)
    return tmp_path / "in"


def test_scan(spark, folder, tmp_path):
    s = fl.validate_folder(spark, str(folder)).first()
    assert (s.valid, s.total_files, s.unsupported_count, s.error_message) == (True, 7, 2, None) and s.total_size > 0
    empty = tmp_path / "empty"
    empty.mkdir()
    (empty / "a.jpg").write_text("x")
    s = fl.validate_folder(spark, str(empty)).first()
    assert (s.valid, s.total_files, s.error_message) == (False, 1, fl.NO_FILES)
    assert fl.validate_folder(spark, str(tmp_path / "none")).first().error_message == "Path does not exist"
    assert fl.validate_folder(spark, str(folder / "readme.txt")).first().error_message == "Path is not a directory"


def test_one_bad_file_is_a_row(spark, folder):
    def extractor(name, data):
        if name == "document1.pdf":
            raise ValueError("no pages")
        return fl.text_tree(name, data)

    out = fl.extract_documents(fl.scan_files(spark, str(folder)), extractor).collect()
    assert len(out) == 7 and [r.error for r in out if r.error] == ["no pages"]


def test_known_hashes_are_duplicates(spark, folder):
    files = fl.hashed_files(fl.scan_files(spark, str(folder))).cache()
    registry = files.selectExpr("concat('id', filename) AS id", "content_hash AS hash")
    assert {r.status for r in rg.dedup_documents(files, registry).collect()} == {"duplicate"}
    twice = files.unionByName(files.withColumn("path", F.concat("path", F.lit("2"))))
    got = rg.dedup_documents(twice, registry.limit(0)).groupBy("status").count().collect()
    assert {r.status: r["count"] for r in got} == {"new": 7, "duplicate": 7}


def test_block_trees(spark, tmp_path):
    tree = {"children": [
        {"block_type": "Page", "children": [{"block_type": "SectionHeader", "html": "1 A"}, {"block_type": "PageHeader", "children": [{"block_type": "SectionHeader", "html": "9 Z"}]}]},
        "text", {"block_type": "Table", "html": "<t/>", "rows": [["a", "b"]], "children": {"no": "list"}},
        *[{"block_type": "Text", "html": str(i)} for i in range(11)],
        {"block_type": "Picture", "images": {"k": "aGk="}},
    ]}
    (tmp_path / "one.json").write_text(json.dumps(tree))
    (tmp_path / "two.json").write_text("{bad")
    trees, rejects = fl.read_block_trees(spark, str(tmp_path))
    assert [r.document_id for r in rejects.collect()] == ["two"]
    rows = fl.flatten_blocks(trees).orderBy("pos").collect()
    assert [r.html for r in rows][:4] == [None, "1 A", "<t/>", "0"] and [r.html for r in rows][12] == "9"
    assert rows[2].rows == [["a", "b"]] and rows[-1].images == {"k": "aGk="}


def test_sessions(spark, tmp_path):
    good = {"session_id": "s1", "user_id": "u", "title": "Chat", "updated_at": "2024-01-02T00:00:00", "starred": False,
            "test_plan_files": {"m1": "/f"}, "messages": [{"role": "user", "content": "Hello World"}]}
    (tmp_path / "a.json").write_text(json.dumps(good, indent=1))
    (tmp_path / "b.json").write_text("{ not json")
    s = fl.read_sessions(spark, str(tmp_path)).cache()
    assert [r.session_id for r in s.collect()] == ["s1"]
    msgs = fl.session_messages(s)
    assert ss.search_sessions(s, msgs, "WORLD").count() == 1 and ss.search_sessions(s, msgs, "none").count() == 0
    assert ss.search_sessions(s, msgs, "").count() == 1
    changes = spark.createDataFrame([("s1", 1, "star", None), ("s1", 2, "rename", "New")], "session_id string, seq int, action string, title string").selectExpr("*", "timestamp'2024-03-01' AS ts")
    r = ss.update_sessions(s, changes).first()
    assert r.starred and r.title == "New"
    asked = spark.createDataFrame([("m1",), ("m2",)], "message_id string")
    assert {r.message_id: r.file_path for r in ss.generated_file_lookup(s, asked).collect()} == {"m1": "/f", "m2": None}


def test_log_lines(spark):
    lines = ['x "GET /api/x HTTP/1.1" 404', '"POST /api HTTP/1.1" 500', '"POST /api/auth/signup HTTP/1.1" 400', '"GET /api HTTP/1.1" 400',
             '"GET /test/a HTTP/1.1" 404', "Warning: old", "fatal: down", "no error", "critical timeout", "deprecated"]
    df = spark.createDataFrame([("s", i, t) for i, t in enumerate(lines)], "source string, line_no long, line string")
    assert {r.line_no: r.severity for r in ops.parse_http_errors(df).collect()} == {0: "error", 1: "critical", 3: "warning"}
    assert {r.line_no: r.severity for r in ops.classify_log_lines(df, "server").collect()} == {5: "warning", 6: "error"}
    assert {r.line_no: r.severity for r in ops.classify_log_lines(df, "container").collect()} == {5: "warning", 6: "critical", 8: "critical", 9: "warning"}


@pytest.mark.parametrize("bucket", [ops.KEY_BUCKET, ops.GLOBAL_BUCKET])
def test_cut_keys_replay_like_whole_ones(spark, bucket):
    rng = random.Random(2)
    rows, ts = [], 1_700_000_000_000_000
    for i in range(3000):
        ts += rng.choice([0, 1_000, 50_000, 400_000, 1_000_000]) + (200_000_000 if rng.random() < 0.003 else 0)
        rows.append((rng.choice("ab"), i, ts, rng.choice([1, 1, 1, 2, 5])))
    df = spark.createDataFrame(rows, "key string, request_id long, ts_us long, cost int").cache()
    key = lambda d: sorted((r.key, r.request_id, r.allowed, round(r.retry_after, 9)) for r in d.collect())
    whole = key(ops.rate_limit_replay(df, bucket))
    assert key(ops.rate_limit_replay(df, bucket, whole_rows=10, segment_us=20_000_000)) == whole
    assert {a for _, _, a, _ in whole} == {True, False}


def test_failures_and_retries(spark):
    registry = spark.createDataFrame([("d1", "PENDING", 0, 3, None), ("d2", "FAILED", 2, 3, "old")], "id string, status string, retry_count int, max_retries int, error_message string")
    failures = spark.createDataFrame([("d1", 1, "a"), ("d1", 70000, "b"), ("d2", 5, "c"), ("d9", 1, "x")], "document_id string, seq long, error string")
    routed, after = rg.route_failures(registry, failures)
    assert sorted((r.document_id, r.seq, r.retry_count, r.action) for r in routed.collect()) == [
        ("d1", 1, 1, "requeue"), ("d1", 70000, 2, "requeue"), ("d2", 5, 3, "dead_letter")]
    assert {r.id: (r.status, r.retry_count, r.error_message) for r in after.collect()} == {
        "d1": ("PENDING", 2, None), "d2": ("FAILED", 3, "Max retries (3) exceeded: c")}
    asked = spark.createDataFrame([("d1",), ("d2",), ("d3",)], "id string")
    assert {r.id: r.queued for r in rg.manual_retry(registry, asked).collect()} == {"d1": False, "d2": True, "d3": False}


def test_event_log_both_forms(spark, tmp_path):
    events = spark.sql("SELECT 'e1' AS event_id, 'SCHEMA_READY' AS event_type, 'd1' AS document_id, timestamp'2024-01-01 10:00:00' AS ts, 'schema.ready' AS routing_key")
    fl.publish_events(events, str(tmp_path / "log"))
    spark.createDataFrame([('{"event_type": "BARE", "document_id": "d2"}',)], "value string").write.mode("append").text(str(tmp_path / "log"))
    got = {r.event_type: (r.document_id, str(r.ts)) for r in fl.read_event_log(spark, str(tmp_path / "log")).collect()}
    assert got == {"SCHEMA_READY": ("d1", "2024-01-01 10:00:00"), "BARE": ("d2", "None")}


def test_plain_text_without_python_equals_the_extractor(spark):
    texts = {"a.txt": "# Scope #\n  \nline one\r\n##  Sub\n \nx\x0by z ", "b.md": "", "c.md": "#\n\"q\" \\ ü"}
    rows = [(n, n, bytearray(t.encode()), True) for n, t in texts.items()] + [("d.txt", "d.txt", bytearray(b"\xff\xfe"), True), ("e.txt", "e.txt", None, True)]
    files = spark.createDataFrame(rows, "path string, filename string, content binary, supported boolean")
    got = {r.filename: r for r in fl.extract_documents(files).collect()}
    for name, text in texts.items():
        assert json.loads(got[name].tree) == fl.text_tree(name, text.encode()) and got[name].error is None
    assert [(got[n].tree, got[n].error) for n in ("d.txt", "e.txt")] == [(None, "invalid UTF-8"), (None, "no content")]
