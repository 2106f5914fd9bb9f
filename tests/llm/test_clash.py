"""Extra columns that have the names of results or helpers, and pages nested deeper than any stack."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from clauseloom.llm import bpe, catalog, html, quality

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("depth", [10, 199, 200, 201, 900, 5000])
def test_deep_pages_keep_their_texts_in_order(depth):
    page = "<html><body><p>" + "".join(f"<div>t{i}" for i in range(depth)) + "<p>end" + "".join(f"<p>u{i}</div>" for i in reversed(range(depth)))
    want = [*[f"t{i}" for i in range(depth)], "end", *[f"u{i}" for i in reversed(range(depth))]]
    root = html.parsed(page)
    assert [t for t, _ in html.blocks(root)] == want
    tree = html.outline([root])
    assert html.match(tree, html.outline([html.parsed(page)]))[0] > 0


def test_what_is_left_out_stays_out_at_any_depth():
    deep = "<div>" * 300 + "<nav><a>menu</a><div>entry</div></nav><p>story <b>bold</b> on</p><script>no</script>" + "</div>" * 300 + "<p>after</p>"
    assert [t for t, _ in html.blocks(html.parsed(deep))] == ["story bold on", "after"]


def test_one_deep_page_does_not_end_the_run(spark):
    rows = [(1, "http://h/1", "<div>" * 3000 + "deep"), (2, "http://h/2", "<p>flat</p>"), (3, "http://h/3", "word " * 300_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract(df, "page_id", "url", "html").collect()}
    assert got[1] == "deep" and got[2] == "flat" and got[3] == ("word " * 300_000).strip()


def test_pages_with_clashing_columns(spark):
    extra = {"pilots": F.lit(1), "template": F.lit("x"), "_host": F.lit("mine"), "nth": F.lit(2), "TEXT": F.lit("gone"), "_own0": F.lit(7)}
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").limit(60)
    plain = {r.page_id: r.text for r in html.extract(pages, "page_id", "url", "html").collect()}
    made = html.extract(pages.withColumns(extra), "page_id", "url", "html")
    assert made.columns == ["page_id", "url", "pilots", "template", "_host", "nth", "_own0", "text", "n_chars"]
    rows = made.collect()
    assert {r.page_id: r.text for r in rows} == plain and {(r.pilots, r.template, r["_host"], r.nth, r["_own0"]) for r in rows} == {(1, "x", "mine", 2, 7)}


def test_tokens_and_scores_with_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(40)
    odd = docs.withColumns({"n_tokens": F.lit("x"), "IDS": F.lit(1), "decoded_sha256": F.lit(2), "score": F.lit("s")})
    encoded = bpe.encode(odd, "text", *catalog.vocabulary())
    assert encoded.columns == ["doc_id", "score", "n_tokens", "ids", "decoded_sha256"]
    assert {r.doc_id: r.ids for r in encoded.collect()} == {r.doc_id: r.ids for r in bpe.encode(docs, "text", *catalog.vocabulary()).collect()}
    model = catalog.quality_model(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    scored = quality.score(odd, "text", model)
    assert scored.columns.count("score") == 1 and all(0 <= r.score <= 1 for r in scored.collect())


def test_stages_with_clashing_and_missing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.withColumns({"score": F.lit("s"), "copies": F.lit("c"), "n": F.lit(1), "_epoch2": F.lit(0)})
    for name, step in corpus_pipeline.STAGES[:4]:
        made = step(spark, odd, SF)
        assert made.columns == odd.columns, name
        rows = made.select("score", "copies", "n").distinct().collect()
        assert [tuple(r) for r in rows] == [("s", "c", 1)], name
    assert corpus_pipeline.cut(spark, docs.drop("n_chars"), SF).columns == docs.drop("n_chars").columns
