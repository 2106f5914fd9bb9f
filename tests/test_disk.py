import json
import os
import time

import numpy as np

from clauseloom.catalog import graph as cg
from clauseloom.catalog import records, retrieval, streams
from clauseloom.catalog import structure as cs
from clauseloom.operators import retrieval as rt
from clauseloom.plans.stage import fresh_path, passing, settled, stage, work_dir
from clauseloom.sources import files as fl


def documents(spark, folder, n=6):
    rows = [(d, ". ".join(f"line {d} x {i} see clause 1.1" for i in range(20 + d))) for d in range(1, n)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


class Left:
    """Which kinds of folders have come into the shared folder and are still there."""

    def __init__(self, spark):
        self.path = work_dir(spark).removeprefix("file:")
        self.before = set(os.listdir(self.path)) if os.path.isdir(self.path) else set()

    def kinds(self):
        return sorted(name[:-33] for name in set(os.listdir(self.path)) - self.before)


def test_what_is_passing_goes_and_what_is_settled_stays(spark):
    left = Left(spark)
    with passing():
        once = stage(spark.range(3), "once")
        a, b = settled(lambda: (stage(once, "inner"), once.selectExpr("id + 1 AS id")), "kept")
        assert left.kinds() == ["kept", "kept", "once"] and [r.id for r in b.orderBy("id").collect()] == [1, 2, 3]
    assert left.kinds() == []
    fresh = fresh_path(spark, "own")
    stage(spark.range(1), "stays")
    assert left.kinds() == ["stays"] and not os.path.exists(fresh)


def test_shuffle_files_go_when_they_have_been_read(spark):
    kept = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {n for n in str(kept.getAllFiles().mkString("|")).split("|") if "shuffle_" in n}
    before = shuffles()
    counted = stage(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count(), "counted")
    end = time.time() + 20
    while shuffles() - before and time.time() < end:
        time.sleep(0.1)
    assert not shuffles() - before and counted.count() == 7


def test_a_stored_graph_is_all_that_stays(spark, tmp_path):
    sf, left = documents(spark, tmp_path / "sf"), Left(spark)
    nodes, edges = cg.stored_graph(spark, sf)
    assert left.kinds() == ["graph", "graph"] and nodes.count() > 0 and edges.count() > 0
    assert retrieval.anchor_expand(spark, sf).count() > 0
    assert "layout-blocks" not in left.kinds() and "parts" not in left.kinds() and "batch" not in left.kinds()


def test_a_transaction_log_reads_one_chunk_table(spark, tmp_path):
    sf, left = documents(spark, tmp_path / "sf"), Left(spark)
    assert cg.graph_transactions(spark, sf).count() == 5
    assert left.kinds() == ["batch", "batch"]


def test_long_chunks_are_all_that_stays(spark, tmp_path):
    sf, left = documents(spark, tmp_path / "sf"), Left(spark)
    assert retrieval.QUERIES["embedding_text_long"](spark, sf).count() > 0 and left.kinds() == ["long-chunks"]
    assert cs.long_chunks(spark, sf).filter("part > 0").count() > 0


def test_what_a_batch_sends_goes_when_it_is_in_the_log(spark, tmp_path):
    sf, left = documents(spark, tmp_path / "sf"), Left(spark)
    assert streams.incremental_edges(spark, sf).count() > 0
    assert left.kinds() == ["chunk-stream", "graph", "graph-checkpoint"]
    streams.graph_commits(spark, sf).count()
    assert left.kinds() == ["chunk-stream", "graph", "graph", "graph-checkpoint"]


def test_tree_files_go_when_their_levels_are_written(spark, tmp_path):
    sf, left = documents(spark, tmp_path / "sf", 10), Left(spark)
    from_files = sorted(map(str, records.read_block_trees(spark, sf).collect()))
    assert not {"layout-blocks", "trees", "tree-files"} & set(left.kinds())
    assert from_files == sorted(map(str, records.flatten_blocks(spark, sf).collect()))


def test_trees_whose_levels_are_mixed(spark):
    leaf = lambda h: {"block_type": "Text", "html": h}
    tree = {"children": [leaf("a"), {"block_type": "Group", "html": "b", "children": [leaf("c"), {"html": "d", "children": [leaf("e")]}, leaf("f")]}, leaf("g"),
                         {"block_type": "PageFooter", "children": [leaf("x")]}]}
    rows = [("t", json.dumps(tree)), ("none", "{}"), ("bad", "{")]
    trees, rejects = fl.parse_block_trees(spark.createDataFrame(rows, "d string, j string"), "d", "j")
    got = [(r.pos, r.html, r.block_type) for r in fl.flatten_blocks(trees).orderBy("pos").collect()]
    assert [h for _, h, _ in got] == list("abcdefg") and [p for p, _, _ in got] == list(range(7)) and got[3][2] is None
    assert [r.document_id for r in rejects.collect()] == ["bad"]
    assert fl.flatten_blocks(trees.filter("document_id = 'none'")).isEmpty()


def test_a_grid_of_many_groups_takes_rounds(spark, monkeypatch):
    at = np.random.default_rng(5)
    vectors = spark.createDataFrame([(i, at.normal(size=4).tolist(), i % 3) for i in range(60)], "vec_id long, embedding array<double>, label long")
    asked = vectors.selectExpr("vec_id AS query_id", "embedding", "CASE WHEN vec_id % 5 > 0 THEN label END AS label")
    found = lambda match: sorted((r.query_id, r.vec_id, round(r.score, 9), r.rank) for r in rt.vector_search(asked, vectors, 3, match=match, block=4).collect())
    plain, filtered = found(None), found("label")
    monkeypatch.setattr(rt, "CELL_BYTES", 500)
    left = Left(spark)
    assert found(None) == plain and left.kinds().count("round") > 2
    assert found("label") == filtered and len(filtered) == len(plain) == 180
