import random

import pytest

from clauseloom.operators import structure as st
from clauseloom.plans.bounded import bounded_rows
from clauseloom.plans.ordered import ordinal, rank_all, segment_of, top_per_key
from clauseloom.plans.stage import stage, work_dir

from test_structure import CASES, blocks


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.6 else f"k{i % 9}", i, rng.choice([0.5, 0.25, rng.random()])) for i in range(4000)]
    return spark.createDataFrame(rows, "k string, pos long, score double").cache()


def numbers(df, name="n"):
    return {(r.k, r.pos): r[name] for r in df.collect()}


def test_numbering_in_pieces_equals_a_window(skewed):
    plain = numbers(skewed.selectExpr("*", "row_number() OVER (PARTITION BY k ORDER BY pos) AS n"))
    cut = skewed.selectExpr("*", f"{segment_of('pos', 50)} AS s")
    assert numbers(ordinal(cut, ["k"], ["s"], ["pos"], "n")) == plain


def test_rank_all_equals_a_window(skewed):
    plain = numbers(skewed.selectExpr("*", "row_number() OVER (PARTITION BY k ORDER BY score DESC, pos) AS n"))
    assert numbers(rank_all(skewed, ["k"], ["score DESC", "pos"], "n")) == plain


def test_top_per_key_prunes_before_the_shuffle(skewed):
    top = top_per_key(skewed, ["k"], ["score DESC", "pos"], 3)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan
    assert top.groupBy("k").count().filter("count > 3").count() == 0


def test_structure_takes_one_shuffle_and_no_python(spark):
    table = stage(blocks(spark, CASES), "blocks")
    plan = st.assign_blocks(table)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort ") == 1
    parts = st._items(st.assign_blocks(table), "full", st.tx.NORMATIVE_WORDS).groupBy("document_id", "seg", "clause_id").count()
    assert parts._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    whole = st.make_chunks(table)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in whole and "CartesianProduct" not in whole and "NestedLoop" not in whole
    check = table.filter(f"pos >= {st.SEGMENT_ROWS}")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(pos,65536)" in check


def test_bounded_rows(spark):
    assert len(bounded_rows(spark.range(5), 5)) == 5 and bounded_rows(spark.range(6), 5) is None


def test_staged_tables_stand_in_the_shared_folder(spark):
    assert stage(spark.range(3)).inputFiles()[0].split(":", 1)[1].lstrip("/").startswith(work_dir(spark).split(":")[-1].lstrip("/"))
