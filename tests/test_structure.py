import base64
import random
import re

import pytest

from clauseloom.operators import graph as gr
from clauseloom.operators import retrieval as rt
from clauseloom.operators import structure as st
from clauseloom.schemas import BLOCKS

H, C, T, P, L, F, PIC = "SectionHeader", "Caption", "Table", "Text", "ListItem", "Footnote", "Picture"
PNG = base64.b64encode(b"\x89PNG1234").decode()
GIF = base64.b64encode(b"GIF89a").decode()


def blocks(spark, docs):
    rows = []
    for doc, items in docs.items():
        for pos, item in enumerate(items):
            kind, html, *rest = item
            extra = rest[0] if rest else {}
            rows.append((doc, pos, kind, html, extra.get("caption"), extra.get("rows"), extra.get("images")))
    return spark.createDataFrame(rows, BLOCKS)


CASES = {
    "lost": [(P, "lost"), (H, "1 Scope"), (P, "x")],
    "split": [(H, "2.1"), (H, "Limits"), (P, "a shall b")],
    "note": [(H, "1 A"), (H, "Note"), (P, "x")],
    "never": [(H, "1 A"), (H, "2.1"), (H, "3 B")],
    "reopen": [(H, "1 A"), (H, "2 B"), (H, "1 C"), (P, "x")],
    "caption": [(H, "1 A"), (C, "Table 4.2 — t"), (P, "p"), (T, "<table/>")],
    "cleared": [(H, "1 A"), (C, "Table 1"), (H, "2 B"), (T, "<table/>")],
    "empty": [(H, "1 A"), (C, "Table 1"), (T, ""), (T, "<table/>")],
    "remark": [(H, "1 A"), (C, "remark")],
    "words": [(H, "1 A"), (P, "It SHALL NOT fail and may stop"), (P, "éshall"), (L, "you Should"), (F, "may")],
    "newline": [(H, "1.2 Safety\nrules"), (P, "x")],
    "newline2": [(H, "1.2\nSafety"), (P, "x")],
    "annex": [(H, "A test setup"), (P, "x")],
    "tree": [(H, f"{c} t") for c in ("1", "1.1", "1.1.2", "3.4", "A", "A.1", "A.1.2", "10")],
    "picture": [(H, "1 A"), (PIC, "", {"caption": "Figure 7", "images": {"/page/0/Picture/0": PNG, "b": "!!"}})],
    "misc": [(PIC, "", {"images": {"/page/0/Picture/0": GIF}})],
    "html": [(H, "<h1> 1 <b>A</b> </h1>"), (P, "<p></p>"), (P, " <p>y</p> ")],
}


@pytest.fixture(scope="module")
def cases(spark):
    b = blocks(spark, CASES).cache()
    return b, st.assign_blocks(b).cache()


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def of(df, doc):
    return df.filter(df.document_id == doc)


def test_clause_of_each_block(cases):
    _, a = cases
    content = st.content_blocks(a)
    assert rows(of(content, "lost"), "clause_id", "type", "text") == [("1", "paragraph", "x")]
    assert rows(of(content, "note"), "clause_id", "text") == [("1", "x")]
    assert rows(of(content, "html"), "clause_id", "text") == [("1", "y")]
    assert rows(of(content, "remark"), "type", "text") == [("caption", "remark")]
    assert rows(of(content, "newline"), "clause_id") == []
    assert rows(of(content, "newline2"), "clause_id") == [("1.2",)]
    dim = st.clause_dim(st.open_clauses(a))
    assert rows(of(dim, "split"), "clause_id", "title") == [("2.1", "Limits")]
    assert rows(of(dim, "never"), "clause_id") == [("1",), ("3",)]
    assert rows(of(dim, "reopen"), "clause_id", "title") == [("1", "A"), ("2", "B")]
    assert rows(of(dim, "annex"), "clause_id", "title") == [("A", "test setup")]


def test_captions_and_tables(cases):
    _, a = cases
    tables = st.extract_tables(a)
    assert rows(of(tables, "caption"), "number", "caption") == [("4.2", "Table 4.2 — t")]
    assert rows(of(tables, "cleared"), "clause_id", "caption") == [("2", None)]
    assert rows(of(tables, "empty"), "pos", "number") == [(3, "1")]
    stats = st.document_statistics(a)
    assert rows(of(stats, "empty"), "total_tables") == [(1,)]


def test_requirements(cases):
    _, a = cases
    reqs = st.extract_requirements(a)
    assert rows(of(reqs, "words"), "pos", "type", "keyword") == [
        (1, "prohibition", "shall not"), (3, "recommendation", "should")]
    assert rows(of(reqs, "split"), "type") == [("mandatory",)]


def test_tree_and_chunks(cases):
    b, a = cases
    tree = st.clause_tree(st.clause_dim(st.open_clauses(a)))
    got = {r.clause_id: r.tree_parent_id for r in of(tree, "tree").collect()}
    assert got == {"1": None, "1.1": "1", "1.1.2": "1.1", "3.4": None, "A": None, "A.1": "A", "A.1.2": "A", "10": None}
    assert [r.clause_id for r in of(st.order_roots(tree), "tree").collect()] == ["1", "3.4", "10", "A"]
    assert [r.clause_id for r in of(st.order_roots(tree, "basic"), "tree").collect()] == ["1", "10", "3.4", "A"]
    chunks = {r.chunk_id: r for r in of(st.make_chunks(b), "tree").collect()}
    assert chunks["3.4"].parent_id == "3" and chunks["A.1.2"].parent_id == "A.1" and chunks["1"].parent_id is None
    assert chunks["A"].children_ids == ["A.1", "A.1.2"]


def test_figures(cases):
    b, a = cases
    figures = st.extract_figures(a)
    assert rows(of(figures, "picture"), "number", "format", "size_bytes", "path") == [
        ("7", "png", 8, "output_images/picture/1/figure_1_page_0_picture_0.png")]
    assert rows(of(st.misc_images(a), "misc"), "number", "format", "path") == [
        (1, "gif", "output_images/misc/misc/misc_1_page_0_picture_0.gif")]
    chunk = of(st.make_chunks(b), "picture").collect()[0]
    assert [(f.number, f.size_bytes) for f in chunk.figures] == [("7", 8)]


def fold(items, basic=False):
    """The same rules as a loop over one document."""
    full = re.compile(r"^([A-Z]|\d+)(?:\.(\d+))*\s+(.+)$", re.I)
    num = re.compile(r"^([A-Z]|\d+)(?:\.(\d+))*\s*$", re.I)
    cap_no = re.compile(r"\b(?:table|figure|fig\.?)\s+[A-Z]?\d+", re.I)
    clause = waiting = caption = None
    out = []
    for kind, html, *rest in items:
        text, taken = html.strip(), None
        if kind == H and text:
            if full.match(text):
                clause, waiting, caption = text.split()[0], None, None
            elif num.match(text):
                waiting = text
            elif waiting:
                clause, waiting, caption = waiting, None, None
        elif kind == C and text and (basic or cap_no.search(text)):
            caption = text
        elif kind == T and html:
            taken, caption = caption, None
        elif kind == PIC:
            taken = caption
            if basic or rest[0]["images"]:
                caption = None
        out.append((clause, taken))
    return out


def random_doc(rng, n):
    def one():
        k = rng.random()
        if k < 0.35:
            return (H, rng.choice(["1 A", "2.1", "Title", "A.1 x", "B", "", "3", "Other words"]))
        if k < 0.55:
            return (C, rng.choice(["Table 1", "Figure 2 - x", "plain", ""]))
        if k < 0.75:
            return (T, rng.choice(["", "<t/>"]))
        if k < 0.85:
            return (PIC, "", {"images": rng.choice([{}, {"a": PNG}])})
        return (P, "x")

    return [one() for _ in range(n)]


@pytest.mark.parametrize("mode", ["full", "basic"])
def test_segments_equal_a_sequential_fold(spark, mode):
    rng = random.Random(5)
    docs = {f"d{i}": random_doc(rng, rng.randint(1, 40)) for i in range(150)}
    b = blocks(spark, docs).cache()
    for size in (1, 3, 1000):
        got = {}
        for r in st.assign_blocks(b, mode, size).collect():
            got.setdefault(r.document_id, {})[r.pos] = (r.clause_id, r.caption_text)
        for doc, items in docs.items():
            want = fold(items, mode == "basic")
            have = [got[doc][p] for p in range(len(items))]
            for (kind, html, *_), w, h in zip(items, want, have):
                assert h[0] == w[0], (doc, size)
                if kind == PIC or (kind == T and html):
                    assert h[1] == w[1], (doc, size)


def test_long_clauses_continue_in_parts(spark):
    rng = random.Random(9)
    docs = {"long": [(H, "1 A")] + random_doc(rng, 60), "short": [(H, "1 A"), (P, "x shall")]}
    b = blocks(spark, docs).cache()

    def merged(size):
        out = {}
        for r in sorted(st.make_chunks(b, segment_rows=size).collect(), key=lambda r: r.part):
            m = out.setdefault((r.document_id, r.chunk_id), {"content": [], "tables": [], "figures": [], "children": [], "title": r.title})
            m["content"] += [(c.type, c.text) for c in r.content]
            m["tables"] += [(t.number, t.caption) for t in r.tables]
            m["figures"] += [(f.number, f.path) for f in r.figures]
            m["children"] += r.children_ids
        return out

    assert merged(7) == merged(1000)


def test_texts_do_not_depend_on_the_segment_size(spark):
    doc = [(H, "1 A"), (P, "one"), (P, "two"), (H, "2 B"), *[(P, f"word{i} shall be") for i in range(6)], (H, "2.1 C"), (P, "x"),
           (T, "<table/>"), (H, "2 again"), (P, "late"), (H, "2.2 D"), (PIC, "", {"images": {"k": PNG}}), (H, "3 E"), (P, ""), (H, "4 F"),
           (H, "5.1 G"), *[(P, "y")] * 5, (H, "5 H"), (H, "5.2 I")]
    b = blocks(spark, {"d": doc, "e": CASES["tree"]}).cache()

    def seen(segment):
        chunks = st.make_chunks(b, segment_rows=segment).cache()
        uniform = gr.uniform_chunks(chunks)
        return (
            rows(st.chunk_levels(chunks), "document_id", "chunk_id", "level", "content_text", "content_length", "has_requirements", "has_tables", "has_figures"),
            rows(gr.clause_nodes(uniform), "uid", "title", "children_uids", "content_text", "content_length", "has_tables", "has_figures"),
            [rows(rt.embedding_text(chunks, n), "uid", "passage", "embed_text", "content") for n in (5, 8000)],
        )

    whole = seen(1000)
    assert seen(4) == whole and seen(1) == whole
    texts = {(d, c): t for d, c, _, t, *_ in whole[0]}
    assert texts["d", "2"] == " ".join(f"word{i} shall be" for i in range(6)) + " late" and texts["d", "3"] == ""
    assert [r[2] for r in whole[1] if r[0] == "clause:d:5"] == [["clause:d:5.1", "clause:d:5.2"]]
    full = {uid: t for uid, _, t, _ in whole[2][1]}
    assert full["clause:d:2"] == "B. " + texts["d", "2"]
    for uid, passage, t, kept in whole[2][0]:
        assert t == full[uid][passage * 5 : passage * 5 + 5] == kept
    assert "".join(t for uid, _, t, _ in whole[2][0] if uid == "clause:d:2") == full["clause:d:2"]
