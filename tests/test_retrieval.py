import numpy as np

from clauseloom.catalog import retrieval as catalog
from clauseloom.operators import grounding as gd
from clauseloom.operators import retrieval as rt
from clauseloom.operators import vector_index as vi
from clauseloom.operators.vector_index import VectorIndex
from clauseloom.plans.stage import fresh_path


def make(spark, n=400, dim=8, seed=3):
    rng = np.random.default_rng(seed)
    # Whole numbers give many ties, which the key must break.
    v = rng.integers(-2, 3, size=(n, dim)).astype(float)
    v[0] = 0
    rows = [(i, v[i].tolist(), f"d{i % 5}") for i in range(n)]
    return v, spark.createDataFrame(rows, "vec_id long, embedding array<float>, document_id string").repartition(6)


def brute(v, q, k, allowed=None):
    def unit(m):
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    s = unit(q) @ unit(v).T
    out = []
    for i in range(len(q)):
        ok = [j for j in range(len(v)) if allowed is None or allowed(i, j)]
        out.append(sorted(ok, key=lambda j: (-round(s[i, j], 12), j))[:k])
    return out, s


def test_exact_search_equals_brute_force(spark, monkeypatch):
    v, vectors = make(spark)
    q = np.random.default_rng(1).normal(size=(13, 8))
    queries = spark.createDataFrame([(i, q[i].tolist(), f"d{i % 5}" if i % 2 else None) for i in range(13)],
                                    "query_id long, embedding array<double>, document_id string")
    for block in (4096, 4):
        monkeypatch.setattr(rt, "QUERY_BLOCK", block)
        for match in (None, "document_id"):
            allowed = None if match is None else (lambda i, j: i % 2 == 0 or j % 5 == i % 5)
            _, s = brute(v, q, 7, allowed)
            got = {}
            for r in rt.vector_search(queries, vectors, 7, match=match).collect():
                got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
            for i in range(13):
                ok = sorted((round(s[i, j], 9) for j in range(len(v)) if allowed is None or allowed(i, j)), reverse=True)[:7]
                assert [round(got[i][k][1], 9) for k in range(1, 8)] == ok
                assert all(allowed is None or allowed(i, x) for x, _ in got[i].values())


def test_ties_go_to_the_smaller_key(spark):
    rows = [(i, [1.0, 0.0]) for i in range(50)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    q = spark.createDataFrame([(0, [2.0, 0.0])], "query_id long, embedding array<float>")
    assert sorted(r.vec_id for r in rt.vector_search(q, vectors, 6).collect()) == list(range(6))


def test_ann_recall(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(8, 16)) * 4
    v = np.vstack([c + rng.normal(size=(60, 16)) for c in centres])
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    queries = spark.createDataFrame([(i, (c + 0.1).tolist()) for i, c in enumerate(centres)], "query_id long, embedding array<float>")
    index = VectorIndex.create(vectors, fresh_path(spark, "index"))
    exact = {(r.query_id, r.vec_id) for r in rt.vector_search(queries, vectors, 5).collect()}
    near = {(r.query_id, r.vec_id) for r in index.search(queries, 5, probe=3).collect()}
    assert len(exact & near) / len(exact) >= 0.9


def test_an_index_takes_vectors_and_cuts_large_lists(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(900, 10))
    v[300:600] = v[0]  # a third of all rows in one list
    rows = [(f"v{i:03}", x.tolist()) for i, x in enumerate(v)] + [("none", None), ("nan", [float("nan")] * 10), ("zero", [0.0] * 10)]
    vectors = spark.createDataFrame(rows, "name string, embedding array<double>")
    queries = spark.createDataFrame([(i, (v[i * 7] + 0.01).tolist()) for i in range(40)], "query_id long, embedding array<double>")
    monkeypatch.setattr(vi, "CELL_ROWS", 50)
    monkeypatch.setattr(vi, "CELL_QUERIES", 8)
    index = VectorIndex.create(vectors.filter("name < 'v500'"), str(tmp_path / "index"), "name")
    index.append(vectors.filter("name >= 'v500'"), writer="w", batch=1)
    index.append(vectors.filter("name >= 'v500'"), writer="w", batch=1)
    assert index.rows().count() == 901
    lists = len(index.model.centres)
    want = {(r.query_id, r.name, r.rank) for r in rt.vector_search(queries, vectors, 6, "name").collect()}
    assert {(r.query_id, r.name, r.rank) for r in index.search(queries, 6, lists, exact_lists=True).collect()} == want
    again = VectorIndex(spark, str(tmp_path / "index"))
    exact = rt.vector_search(queries, vectors, 6, "name").select("query_id", "name")
    assert again.recall(queries.filter("query_id > 0"), 6, lists, exact.filter("query_id > 0")) >= 0.9
    assert index.search(queries.limit(0), 6, 3).count() == 0


def test_many_queries_read_the_vectors_once(spark):
    v, vectors = make(spark)
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(np.random.default_rng(4).normal(size=(300, 8)))], "query_id long, embedding array<double>")
    path = fresh_path(spark, "vectors")
    vectors.write.parquet(path)
    found = rt.vector_search(queries, spark.read.parquet(path), 3, block=16)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count(path.rsplit("/", 1)[1]) <= 1 and plan.count("embedding#") > 0
    want = {(r.query_id, r.vec_id) for r in rt.vector_search(queries, vectors, 3).collect()}
    assert {(r.query_id, r.vec_id) for r in found.collect()} == want


def test_registered_ann_search_finds_nine_of_ten(spark):
    sf = "/root/testdata/sf0.01"
    exact = {(r.query_id, r.vec_id) for r in rt.vector_search(catalog.centroids(spark, sf), catalog._vectors(spark, sf), 10).collect()}
    near = {(r.query_id, r.vec_id) for r in catalog.ann_search(spark, sf).collect()}
    print("recall", len(exact & near) / len(exact))
    assert len(exact & near) / len(exact) >= 0.9


def test_encoders(spark):
    texts = spark.createDataFrame([("d", "1", "A b. shall c", "x")], "document_id string, chunk_id string, embed_text string, content string")
    hashed = rt.embed_chunks(texts, rt.hashing_encoder(16)).first()
    assert abs(sum(x * x for x in hashed.embedding) - 1) < 1e-6
    model = rt.embed_chunks(texts, rt.model_encoder(lambda: lambda batch: [[float(len(t)), 1.0] for t in batch])).first()
    assert model.embedding == [12.0, 1.0]


def test_groundedness(spark):
    texts = spark.createDataFrame([(1, "The unit works. Zebra quokka? a | b"), (2, ""), (3, "unit unit unit zebra")], "text_id long, text string")
    context = spark.createDataFrame([("the unit",), ("works. A",)], "content string")
    scores, flagged = gd.groundedness(texts, context)
    got = {r.text_id: (r.grounded, r.sentences, round(r.score, 6)) for r in scores.collect()}
    assert got == {1: (2, 4, 0.5), 2: (0, 0, 0.0), 3: (1, 1, 1.0)}
    assert {r.sentence for r in flagged.collect()} == {"Zebra quokka?", "b"}


def test_plans(spark):
    answers = spark.createDataFrame([
        (1, 'Sure: {"sources_used": ["a", "z"], "test_cases": [{"procedure": "p", "source_chunks": ["y"]}, {"id": "TC_9"}]} bye'),
        (2, "no json"), (3, "{broken"), (4, '{"a": 1'), (5, '{"a": }'),
    ], "query_id long, response string")
    plans = gd.extract_json(answers, "response").cache()
    assert [r.query_id for r in plans.filter("parsed IS NOT NULL").collect()] == [1]
    cases = {r.id: r for r in gd.test_cases(plans).collect()}
    assert set(cases) == {"TC_001", "TC_9"} and cases["TC_9"].requirement_type == "informative" and cases["TC_9"].source_chunks == []
    context = spark.createDataFrame([(1, "a")], "query_id long, uid string")
    warnings = {r.source for r in gd.source_warnings(plans, context).collect()}
    assert warnings == {"z", "y"}
    assert gd.validate_sources(plans, context).first().is_valid is False
    told = {r.source: (r.case_id, r.warning) for r in gd.source_warnings(plans, context).collect()}
    assert told["z"] == (None, "Referenced source 'z' not in provided context")
    assert told["y"] == ("TC_001", "Test case TC_001 references unknown source 'y'")


def test_intent_and_types(spark):
    msgs = spark.createDataFrame([(1, "Hello!"), (2, " hi there "), (3, "Please create a TEST plan"), (4, "hello you")], "id long, text string")
    got = {r.id: (r.is_test_plan_request, r.is_greeting) for r in gd.message_intent(msgs, "text").collect()}
    assert got == {1: (False, True), 2: (False, True), 3: (True, False), 4: (False, False)}
    refs = spark.createDataFrame([("iec 61000-4-2:2008",), ("CISPR 32",), ("ISO 1",)], "standard string")
    types = sorted((r.standard, r.test_type) for r in gd.test_type_lookup(refs).collect())
    assert types == [("CISPR 32", "conducted_emissions"), ("CISPR 32", "radiated_emissions"), ("ISO 1", "other"), ("iec 61000-4-2:2008", "electrostatic_discharge")]


def test_coverage(spark):
    reqs = spark.createDataFrame([("r1",), ("r2",), ("r3",)], "requirement_id string")
    cases = spark.createDataFrame([("r1", "b"), ("r1", "a"), ("r1", "a"), ("r3", "c"), ("r9", "d")], "requirement_id string, test_case_id string")
    matrix = gd.coverage_matrix(reqs, cases)
    assert {r.requirement_id: (r.n_tests, r.coverage_status) for r in matrix.collect()} == {
        "r1": (2, "covered"), "r2": (0, "not_covered"), "r3": (1, "covered")}
    s = gd.coverage_summary(matrix).first()
    assert (s.total_requirements, s.covered_requirements, s.coverage_percentage) == (3, 2, 66.7)
    assert sorted(map(tuple, gd.covered_by(reqs, cases).collect())) == [("r1", "a"), ("r1", "b"), ("r3", "c")]


def test_search_leaves_out_odd_vectors_and_repeated_queries(spark):
    nan = float("nan")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [nan, 1.0]), (5, [None, 1.0])], "vec_id long, embedding array<float>")
    queries = spark.createDataFrame([(7, [1.0, 0.1]), (7, [1.0, 0.1]), (8, None), (9, [nan, 0.0])], "query_id long, embedding array<float>")
    got = [(r.query_id, r.vec_id, r["rank"]) for r in rt.vector_search(queries, vectors, 3).collect()]
    assert sorted(got) == [(7, 1, 1), (7, 2, 2)]
    assert rt.vector_search(queries.limit(0), vectors, 3).count() == 0


def test_questions_reach_their_clauses_and_neighbours(spark):
    said = {"1": "pumps and valves", "2": "wind noise level", "3": "oil leak test of pumps", "4": "cable colour"}
    texts = spark.createDataFrame(
        [("d", c, p, f"clause:d:{c}", f"T{c}", t, t) for c, t in said.items() for p in (0, 1)],
        "document_id string, chunk_id string, passage int, uid string, title string, embed_text string, content string",
    )
    nodes = spark.createDataFrame(
        [(f"clause:d:{c}", "Clause", "d", f"T{c}", t) for c, t in said.items()],
        "uid string, label string, document_id string, title string, content_text string",
    )
    edges = spark.createDataFrame([("clause:d:2", "CONTAINS", "clause:d:4")], "source_uid string, rel_type string, target_uid string")
    questions = spark.createDataFrame([(1, "noise of wind"), (2, "oil pumps")], "query_id long, text string")
    encode = rt.hashing_encoder(4096)
    vectors = {r.chunk_id: np.array(r.embedding, float) for r in rt.embed_chunks(texts, encode).collect()}
    asked = {r.query_id: np.array(r.embedding, float) for r in encode(questions, "text").collect()}
    got = {r.query_id: r.context for r in rt.answer_context(questions, texts, nodes, edges, encode, k=4, n=9).collect()}
    for q, v in asked.items():
        # Both passages of a clause are alike, so four passages are the two nearest clauses.
        near = sorted(said, key=lambda c: (-round(float(v @ vectors[c]), 6), c))[:2]
        around = [c for s in near for c in {"2": "4", "4": "2"}.get(s, "") if c not in near]
        want = [f"[SOURCE: clause:d:{c}]\nT{c}\n{said[c]}" for c in near + around]
        assert got[q] == "\n\n".join(want)
    assert got[1].startswith("[SOURCE: clause:d:2]") and got[2].startswith("[SOURCE: clause:d:3]")


def test_one_long_clause_leaves_room_for_others(spark):
    """Twelve near passages are one clause; what matched reaches the context whole."""
    rows = [("1", p, "wind noise level") for p in range(12)] + [("2", 0, "wind noise"), ("3", 0, "wind"), ("4", 0, "cable")]
    texts = spark.createDataFrame(
        [("d", c, p, f"clause:d:{c}", f"T{c}", t, t) for c, p, t in rows],
        "document_id string, chunk_id string, passage int, uid string, title string, embed_text string, content string",
    )
    questions = spark.createDataFrame([(1, "wind noise level"), (2, "cable")], "query_id long, text string")
    encode = rt.hashing_encoder(4096)
    asked = encode(questions, "text").select("query_id", "embedding")
    got = rt.search_clauses(asked, rt.embed_chunks(texts, encode), 3, by_clause=True).collect()
    assert [r.uid for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 1] == [f"clause:d:{c}" for c in "123"]
    assert sum(r.query_id == 2 for r in got) == 3


def test_passages_are_kept_whole(spark, monkeypatch):
    said = spark.createDataFrame([("d", "1", 0, "T", "x" * 7000)], "document_id string, chunk_id string, passage int, title string, text string")
    monkeypatch.setattr(rt.st, "text_passages", lambda chunks, n: chunks)
    assert rt.embedding_text(said).first().content == "x" * 7000
    assert rt.embedding_text(said, kept_chars=2000).first().content == "x" * 2000


def test_a_vector_goes_to_few_cells(spark, monkeypatch):
    _, vectors = make(spark)
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(np.random.default_rng(4).normal(size=(300, 8)))], "query_id long, embedding array<double>")
    sent, real = [], rt.in_cells

    def counting(asked, held, *args, **kwargs):
        sent.append((asked.count(), held.count()))
        return real(asked, held, *args, **kwargs)

    monkeypatch.setattr(rt, "in_cells", counting)
    for match in (None, "document_id"):
        asked = queries if match is None else queries.selectExpr("*", "CASE WHEN query_id % 3 > 0 THEN concat('d', query_id % 5) END AS document_id")
        rt.vector_search(asked, vectors, 3, match=match, block=4).count()
    assert sent[0] == (300, 400) and sent[1][0] == 300 and sent[1][1] <= 800


def test_the_best_of_many_ties_and_odd_lengths():
    rng = np.random.default_rng(9)
    v = rng.integers(-1, 2, size=(700, 3)).astype(float)
    v[5], v[6], v[7] = [1e200, 1e200, 0], [1e-160, 0, 0], [0, 0, 0]
    q = np.vstack([rng.integers(-1, 2, size=(40, 3)), np.zeros((1, 3)), [[1e-170, 0, 0]]]).astype(float)
    keys = np.arange(700)
    with np.errstate(all="ignore"):
        length = np.outer(rt._lengths(q), rt._lengths(v))
        score = np.divide(q @ v.T, length, out=np.zeros(length.shape), where=length > 0)
    for ordered in (True, False):
        order = np.arange(700) if ordered else rng.permutation(700)
        best = rt._Best(q, np.arange(len(q)), 6, 7, ordered)
        for at in np.array_split(order, 5):
            best.see(v[at], keys[at].astype(object))
        for i in range(len(q)):
            assert best.key[i].tolist() == sorted(keys[np.isfinite(score[i])], key=lambda j: (-score[i, j], j))[:6]


def test_letters_are_counted_in_one_pass(spark):
    texts = spark.createDataFrame([("Aa zZ é",), ("",), (None,), ("ÀÁ qA",)], "text string")
    got = texts.select("text", catalog._letters("text")).selectExpr("text", "embedding", f"array({catalog._COUNTS}) AS want").collect()
    assert all(r.embedding == (r.want if r.text is not None else None) for r in got)


def test_distances_come_in_pieces(monkeypatch):
    rng = np.random.default_rng(2)
    model = vi.Model(rng.normal(size=(30, 6)), rng.normal(size=(3, 8, 2)))
    unit = rng.normal(size=(100, 6))
    whole, codes = model.lists(unit, 4), model.encode(unit, np.zeros(100, int))
    monkeypatch.setattr(vi, "DISTANCES", 100)
    assert max(len(p) for p in vi._pieces(unit, 30)) == 3
    assert (model.lists(unit, 4) == whole).all() and (model.encode(unit, np.zeros(100, int)) == codes).all()
    assert model.lists(unit[:0], 4).shape == (0, 4)
