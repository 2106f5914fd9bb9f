import os

from pyspark.sql import functions as F

from clauseloom.catalog import fixtures as fx
from clauseloom.catalog import graph as cg
from clauseloom.catalog import records, streams
from clauseloom.catalog import structure as cs
from clauseloom.plans.stage import fresh_path


def documents(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_numbers_stand_alone_and_no_line_is_lost(spark, tmp_path):
    lines = {d: [f"line{d}x{i}" for i in range(n)] for d, n in ((1, 30), (2, 2), (4, 20))}
    sf = documents(spark, tmp_path / "sf", [(d, "\n".join(x)) for d, x in lines.items()] + [(9, None), (10, "")])
    blocks = fx.document_blocks(spark, sf).collect()
    for d, own in lines.items():
        told = " ".join(f"{b.html} {b.images}" for b in blocks if b.document_id == f"doc{d}")
        # A table without HTML keeps its line in its rows, as it always did.
        rows = " ".join(str(b.rows) for b in blocks if b.document_id == f"doc{d}")
        assert all(x in told or x in rows for x in own)
    heads = {(r.document_id, r.html): r.kind for r in cs.QUERIES["classify_header"](spark, sf).select("document_id", "kind", "pos").join(
        spark.createDataFrame([(b.document_id, b.pos, b.html) for b in blocks], "document_id string, pos long, html string"), ["document_id", "pos"]).collect()}
    assert heads[("doc1", "1.1")] == "num" and heads[("doc1", "<b>Part</b> line1x2 line1x3")] == "text"
    # The last line of a text has no header after it.
    assert heads[("doc2", "1.1 line2x1")] == "full"
    titles = {(r.document_id, r.clause_id): r.title for r in cs._opened(spark, sf).selectExpr("document_id", "clause_id", "title").collect()}
    assert titles[("doc1", "1.1")] == "Part line1x2 line1x3"


def test_a_batch_of_the_stream_is_many_files(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(streams, "incremental_graph", lambda stream, root, checkpoint: seen.update(stream=stream, checkpoint=checkpoint))
    streams._batches(spark, spark.range(400).selectExpr("id", "concat('c', id) AS chunk_id"), "chunk_id")
    batches = []
    query = seen["stream"].writeStream.foreachBatch(lambda b, i: batches.append((b.count(), len(b.inputFiles())))).option("checkpointLocation", seen["checkpoint"]).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sum(n for n, _ in batches) == 400 and len(batches) >= 3
    written = spark.conf.get("spark.sql.shuffle.partitions")
    assert len(batches) < int(written) or int(written) <= 4


def test_tree_files_are_written_by_tasks(spark):
    path = fresh_path(spark, "trees")
    records._write_folders(spark.createDataFrame([("doc1", "{}"), ("doc2", "é\n[")], "document string, value string"), path)
    assert sorted(os.listdir(path)) == ["document=doc1", "document=doc2"]
    got = {r.document_id: r.value for r in spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(
        F.regexp_extract("_metadata.file_path", "=([^/]+)/", 1).alias("document_id"), "value").collect()}
    assert got == {"doc1": "{}\n", "doc2": "é\n[\n"}


def test_a_text_may_end_in_a_number_alone(spark, tmp_path):
    sf = documents(spark, tmp_path / "sf", [(2, "a\nb"), (1, "\n".join(f"l{i}" for i in range(30))), (9, None)])
    blocks = [(b.pos, b.block_type, b.html) for b in fx.document_blocks(spark, sf, numbers_end=True).filter("document_id = 'doc2'").orderBy("pos").collect()]
    assert blocks[1:] == [(1, "SectionHeader", "1.1"), (2, "Text", "b")]
    # The rest is as ever.
    same = fx.document_blocks(spark, sf).filter("document_id = 'doc1'").drop("images")
    assert fx.document_blocks(spark, sf, numbers_end=True).filter("document_id = 'doc1'").drop("images").exceptAll(same).isEmpty()
    roots = {(r.document_id, r.clause_id) for r in cs.QUERIES["order_roots"](spark, sf).collect()}
    assert ("doc2", "1.1") not in roots and {d for d, _ in roots} == {"doc1"}
    listed = {r.document_id: r.total_clauses for r in cg.QUERIES["list_graph_documents"](spark, sf).collect()}
    assert listed["doc2"] == 0 and listed["doc1"] > 0 and len(listed) == 2
