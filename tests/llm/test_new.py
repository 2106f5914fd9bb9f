"""Secret scans, whitening and the Merkle manifest: against brute force and on the edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from clauseloom.llm import catalog, merkle, secrets, whitening

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# Secret scans


def base_spans(text):
    """The contract in plain words, shape by shape."""
    found = []
    for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        found += [(m.start(), 0, "assign", m.end())] if len(m[2]) >= 12 else []
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def told(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def entropy(chars):
    return -sum(c / len(chars) * math.log2(c / len(chars)) for c in Counter(chars).values())


def test_windows_equal_entropy_counted_anew():
    rnd = random.Random(3)
    for size in (1, 2, 7, 20):
        for alphabet in ("ab", "0123456789abcdef", "aB3+/xyz0"):
            text = "".join(rnd.choices(alphabet, k=size + rnd.randint(0, 60)))
            got = list(secrets.windows(text, size))
            assert len(got) == len(text) - size + 1
            for i, (bits, mixed) in enumerate(got):
                window = text[i : i + size]
                assert math.isclose(bits, entropy(window), abs_tol=1e-9)
                assert mixed == (any(map(str.isdigit, window)) and any(map(str.isalpha, window)))


def more_spans(text, base):
    """Every window by itself, neighbours joined, then the allow-list and what is covered already."""
    taken, out = [(s, e) for _, s, e in base], []
    for kind in secrets.CLASSES:
        new = []
        for m in re.finditer(kind.run, text):
            marked = set()
            for i in range(len(m[0]) - kind.window + 1):
                w = m[0][i : i + kind.window]
                if entropy(w) >= kind.bits - 1e-9 and any(map(str.isdigit, w)) and any(map(str.isalpha, w)):
                    marked.update(range(m.start() + i, m.start() + i + kind.window))
            # Runs of marked characters; windows that only touch are one span, as they share no gap.
            for i in sorted(marked):
                if i - 1 not in marked:
                    end = i
                    while end in marked:
                        end += 1
                    if not secrets.Scanner().lets_pass(m[0]) and not any(s <= i and end <= e for s, e in taken):
                        new.append((kind.kind, i, end))
        out += new
        taken += [(s, e) for _, s, e in new]
    return out


def test_scan_equals_brute_force_and_spares_words():
    rnd = random.Random(9)
    base64 = "".join(rnd.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=64))
    upper_hex = "".join(rnd.choices("0123456789ABCDEF", k=40))
    odd = [
        f"key {base64} end", f"id {upper_hex}.", f"password = '{base64}'", "TOKEN:abcdefghijk", "token:abcdefghijkl", "Secret\"  =  \"a.b.c.d.e.f.g",
        "AKIA" + "A" * 13, "AKIA" + "A" * 14, "f" * 15, "f" * 16, "secret=token=abcdefghijkl password: x", "päßword ſecret=abcdefghijklmnop 😀 api_key=0123456789ab",
        "123e4567-e89b-12d3-a456-426614174000", "Donaudampfschifffahrtsgesellschaftskapitaen", "snake_case_words_that_are_long_and_have_2_numbers_10",
        "D41D8CD98F00B204E9800998ECF8427E", "abcdefghijklmnopqrstuvwxyz0123456789", "x" * 100 + upper_hex + "y" * 100 + base64 + "=" * 50,
        "".join(rnd.choices("ab1", k=3000)) + base64,
    ]
    texts = odd + [t for (t,) in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet' WHERE text IS NOT NULL").fetchall()]
    scanner = secrets.Scanner()
    for text in texts:
        base, more = scanner.scan(text)
        assert base == base_spans(text)
        assert sorted(more) == sorted(more_spans(text, base))
    assert scanner.scan(odd[0])[1]
    assert scanner.scan(odd[1])[1] == [("entropy_hex", 3, 43)]
    for text in odd[12:15]:
        assert scanner.scan(text) == ([], [])
    # The allow-list takes away what the windows found, and nothing else.
    assert secrets.Scanner(allowed=(re.escape(base64),), known=frozenset()).scan(odd[0])[1] == []


def test_scan_of_edge_cases(spark):
    rows = [(1, None, 5, "x"), (2, "", 5, "x"), (3, "token = deadbeefdeadbeef", 5, "x"), (3, "token = deadbeefdeadbeef", 5, "x"), (None, "ab " * 200_000 + "f" * 16, 5, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, N_HEX int, run string")
    out = secrets.scan(df, "text").collect()
    # The input's own N_HEX makes way for the result.
    assert set(out[0].asDict()) == {"doc_id", "text", "run", "n_assign", "n_access", "n_hex", "base_sha256", "spans"}
    by_id = {r.doc_id: r for r in out}
    assert len(out) == 5 and by_id[1].spans == by_id[2].spans == "" and by_id[1].base_sha256 == sha("")
    assert by_id[3].spans == "assign:0:24,hex:8:24" and by_id[3].base_sha256 == sha(by_id[3].spans)
    assert by_id[None].spans == "hex:600000:600016" and (by_id[None].n_assign, by_id[None].n_hex) == (0, 1)
    assert secrets.scan(df.limit(0), "text").count() == 0


def test_secrets_query(spark):
    got = {r.doc_id: r for r in catalog.op11_secrets(spark, LARGER).collect()}
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{LARGER}/documents.parquet'").fetchall()
    assert len(got) == len(rows)
    for doc_id, text in rows:
        base = base_spans(text or "")
        r, kinds = got[doc_id], Counter(k for k, _, _ in base)
        assert (r.n_assign, r.n_access, r.n_hex) == (kinds["assign"], kinds["access"], kinds["hex"])
        assert r.base_sha256 == sha(told(base)) and set(told(base).split(",")) <= set(r.spans.split(","))
    assert any(r.n_assign for r in got.values()) and any(r.n_hex for r in got.values())


# Whitening


@pytest.mark.parametrize("d, rank", [(1, 1), (8, 8), (33, 33), (20, 7), (6, 0)])
def test_components_equal_a_library(d, rank):
    rng = np.random.default_rng(d)
    a = rng.normal(size=(d, rank)) * 10.0 ** -np.linspace(0, 5, rank)
    scatter = a @ a.T
    values, units = whitening.components(scatter)
    assert len(values) == rank
    if rank:
        assert np.allclose(values, np.linalg.eigvalsh(scatter)[::-1][:rank], rtol=1e-9, atol=1e-14 * values[0])
        assert np.abs(units.T @ units - np.eye(rank)).max() < 1e-12 and np.abs(scatter @ units - units * values).max() < 1e-13 * values[0] * d


def whitened_by_brute_force(rows, count=16):
    """x of every row and the covariance of the distinct ones, in whole numbers."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in rows]
    fit = sorted({tuple(v) for v in x})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    big = np.array([[n * a - b for a, b in zip(v, s)] for v in fit], object)
    cov = (big.T @ big).astype(float) / n**3
    return x, n, s, cov


def check_whitening(got, rows, keys):
    x, n, s, cov = whitened_by_brute_force(rows)
    values = np.linalg.eigvalsh(cov)[::-1]
    table = defaultdict(list)
    for r in got:
        table[r.vec_id].append(r)
    assert sorted(table) == sorted(set(keys))
    k = min(16, int((values > values[0] * 1e-12).sum()))
    where = {}
    for key, v in zip(keys, x):
        mine = sorted(table[key], key=lambda r: r.component)
        assert {r.deviation for r in mine} >= {sum((n * a - b) ** 2 for a, b in zip(v, s))}
        where[key] = [r.whitened for r in mine[:: max(1, keys.count(key))]][:k]
        assert [r.component for r in mine] == sorted(list(range(1, k + 1)) * keys.count(key)) and {r.n for r in mine} == {n}
        assert np.allclose([r.explained for r in mine[:: keys.count(key)]], values[:k] / cov.trace(), rtol=1e-9)
        assert {r.identity_error for r in mine} == {got[0].identity_error}
    # Whitened squares equal the quadratic form of the inverse covariance, whatever the signs and ties.
    vals, units = np.linalg.eigh(cov)
    units, vals = units[:, ::-1][:, :k], vals[::-1][:k]
    centred = np.array([[float(a) - b / n for a, b in zip(v, s)] for v in x])
    want = np.abs(centred @ units / np.sqrt(vals))
    for key, w in zip(keys, want):
        if keys.count(key) == 1:
            assert np.allclose(np.abs(where[key]), w, rtol=1e-6, atol=1e-6)
    assert got[0].identity_error < 1e-9


def test_whitening_query(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet' ORDER BY vec_id").fetchall()
    check_whitening(catalog.op12_whitening(spark, SF).collect(), [v for _, v in rows], [k for k, _ in rows])


def test_whitening_of_edge_cases(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(30)]
    rows += [(100 + i, rows[0][1]) for i in range(50)] + [(7, rows[3][1]), (None, rows[4][1])]
    bad = [(200, None), (201, [1.0, None, 2.0, 3.0]), (202, [float("nan")] * 4), (203, [float("inf"), 0.0, 0.0, 0.0]), (204, [])]
    schema = "component long, n array<double>"  # the names of two results
    df = spark.createDataFrame(rows + bad, schema)
    got = whitening.whiten(df, "component", "n").collect()
    assert len(got) == 4 * len(rows) and {r.n for r in got} == {30}
    assert len([r for r in got if r.vec_id == 7]) == 8 and len([r for r in got if r.vec_id is None]) == 4
    copies = {(r.component, r.whitened) for r in got if r.vec_id in (0, *range(100, 150))}
    assert len(copies) == 4
    assert whitening.whiten(df.limit(0), "component", "n").count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema), "component", "n").count() == 0
    with pytest.raises(ValueError, match="differ in length"):
        whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], schema), "component", "n")
    # Beyond the exact range of doubles and of longs.
    far = [(i, [c * 1e9, -c * 1e14]) for i, c in enumerate((1.0, 2.5, -3.0, 7.25))] + [(9, [1e300, -1e300])]
    got = whitening.whiten(spark.createDataFrame(far, schema), "component", "n").collect()
    assert {r.vec_id for r in got} == {0, 1, 2, 3, 9} and all(r.deviation is None for r in got)
    assert all(math.isfinite(r.whitened) for r in got) and got[0].identity_error < 1e-4


# Merkle manifest


def sized(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree_of(hashes):
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def proof_of(levels, at):
    out = []
    for level in levels[:-1]:
        mate = at ^ 1
        out.append((at & 1, level[mate] if mate < len(level) else ""))
        at //= 2
    return out


def manifest_by_brute_force(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    leaf = lambda r: sha(*map(sized, r))
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, bytes.fromhex(leaf(r))))
    trees = {g: tree_of([leaf(r) for r in groups[g]]) for g in names}
    top = tree_of([trees[g][-1][0] for g in names])
    out = []
    for j, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            proof = proof_of(trees[g], i) + proof_of(top, j)
            folded = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                folded = leaf((*r[:3], None if r[3] is None else r[3] + 1, r[4]))
            for left, mate in proof:
                folded = sha(mate, folded) if left else sha(folded, mate)
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], sha(*[m for _, m in proof]), folded, folded == top[-1][0]))
    return sorted(out, key=str)


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def manifest(df, bits):
    made = merkle.manifest(
        df, "doc_id", "lang", FIELDS, {"n_chars": F.col("n_chars").cast("decimal(38,0)") + 1}, F.crc32(F.col("doc_id").cast("string")) % 7 == 0, bits,
    )
    return sorted([tuple(r) for r in made.collect()], key=str)


@pytest.mark.parametrize("bits", [1, 2, 10])
def test_manifest_equals_brute_force(spark, bits):
    rnd = random.Random(bits)
    rows = []
    for lang, n in ((None, 3), ("", 1), ("de", 17), ("en", 33 if bits < 10 else 1100), ("é", 8), ("z", 2), ("日本", 5)):
        rows += [(rnd.randint(0, 10**6), rnd.choice([None, "s1", "ß"]), lang, rnd.choice([None, 5, 2**63 - 1]), rnd.choice([None, "", "ab", "日本 "])) for _ in range(n)]
    rows += [(None, "a", "de", 1, "x"), (None, "b", "de", 1, "x"), (5, "a", "z", 1, "x"), (5, "a", "z", 1, "x"), (-7, None, "z", 0, "y" * 1_000_000)]
    df = spark.createDataFrame([(*r, "clash", 1, b"") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, k string, tree int, leaf binary")
    assert manifest(df, bits) == manifest_by_brute_force(rows)


def test_manifest_of_few_rows(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    limit = spark.conf.get("spark.sql.cteRecursionRowLimit")
    for rows in ([], [(1, "s", "en", 2, "ab")], [(1, "s", "en", 2, "ab"), (2, "s", None, 2, "ab")], [(i, None, None, None, None) for i in range(5)]):
        assert manifest(spark.createDataFrame(rows, schema), 2) == manifest_by_brute_force(rows)
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == limit


def test_no_row_of_the_store_meets_more_leaves_than_a_block(spark):
    rows = [(i, "s", "en", i, "t") for i in range(300)] + [(1000 + i, "s", "de", i, "t") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    nodes = df.selectExpr("CASE lang WHEN 'de' THEN 0L ELSE 1L END AS tree", "CASE lang WHEN 'de' THEN 3L ELSE 300L END AS n", "doc_id % 1000 AS pos",
                          "unhex(sha2(text, 256)) AS h", "struct(doc_id AS k, CAST(NULL AS BINARY) AS altered) AS row")
    floors, roots = merkle.build(nodes, 2)
    assert [f.count() for f in floors] == [303, 75, 19, 5, 2] and roots.count() == 2
    forest, _ = merkle.build(roots.selectExpr("-1L AS tree", "2L AS n", "tree AS pos", "h", "CAST(NULL AS STRUCT<x: INT>) AS row"), 2)
    store = merkle.links(floors, forest, spark.createDataFrame([(0, 0, 1), (1, 1, 5)], "tree long, place long, hops int"), 2)
    met = floors[0].join(store, ["tree", "seat"]).groupBy("tree", "seat", "step").count()
    assert met.agg(F.max("count")).first()[0] <= 4 and store.groupBy("tree", "seat", "step").count().filter("count > 1").isEmpty()
    assert store.filter("up IS NULL").count() == 76
