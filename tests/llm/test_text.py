"""Encoding, near-dedup, substring dedup, quality: against brute force on small fixtures and on the edge cases."""

import collections
import hashlib
import random
import re

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from clauseloom.llm import bpe, catalog, neardup, quality, substring
from clauseloom.plans.stage import stage

SF = "/root/testdata/sf0.001"
EDGE = [
    (1, None, 5), (2, "", 5), (3, "   \n", 5), (4, "one two", 5), (5, "same words here and there again", 5), (5, "same words here and there again", 5),
    (6, "same words here and there again", 5), (None, "a text without a key of six words", 5), (7, "lang " * 30000, 5),
]
#: A third column whose name some operators use inside.
SCHEMA = "doc_id long, text string, k int"


def documents():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(*catalog.vocabulary())


@pytest.fixture(scope="module")
def tik(encoder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.vocabulary.ids, special_tokens={})


def flat(encoder, text):
    return [i for block in encoder.encode(text) for i in block]


def test_bpe_equals_the_library(encoder, tik):
    rnd = random.Random(5)
    parts = ["a", "b", " ", "  ", "\n", "\t", "'s", "'", "0", "12", "é", "日本", "　", "\x1c", "\x85", "!!", "́", "😀", "the", "ing", "²", "Ⅷ", "A"]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 30))) for _ in range(3000)] + [t for _, t in documents()]
    for text in texts:
        ids = flat(encoder, text)
        assert ids == tik.encode_ordinary(text)
        assert encoder.decode(ids) == text.encode()


def test_blocks_change_nothing(encoder, tik, monkeypatch):
    text = " ".join(t for _, t in documents()[:40])
    monkeypatch.setattr(bpe, "BLOCK", 1000)
    assert flat(encoder, text) == tik.encode_ordinary(text)


def test_pairs_appends_and_edits(encoder):
    v, rnd = encoder.vocabulary, random.Random(6)
    tokens = list(v.tokens)
    for _ in range(5000):
        a, b = rnd.choice(tokens), rnd.choice(tokens)
        assert v.fits(a, b) == (v.merged(v.tokens[a] + v.tokens[b]) == [a, b])
    for _ in range(200):
        data = bytes(rnd.choices(b"abcdeinrst ", k=rnd.randint(1, 400)))
        entries = bpe.Prefixes(v, data[:7])
        entries.append(data[7:])
        assert entries.ids() == v.merged(data)
        i = rnd.randint(0, len(data))
        j, new = min(len(data), i + rnd.randint(0, 9)), bytes(rnd.choices(b"abcdeinrst ", k=rnd.randint(0, 9)))
        entries.replace(i, j, new)
        assert entries.data == data[:i] + new + data[j:] and entries.ids() == v.merged(entries.data)


def test_bpe_query(spark, encoder, tik):
    got = {r.doc_id: r for r in catalog.op3_bpe(spark, SF).collect()}
    for d, text in documents():
        ids = tik.encode_ordinary(text or "")
        assert got[d].n_tokens == len(ids)
        assert got[d].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[d].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_bpe_edges_and_round_trip(spark):
    df = spark.createDataFrame(EDGE, SCHEMA)
    made = bpe.encode(df, "text", *catalog.vocabulary())
    back = bpe.decode(made, "ids", *catalog.vocabulary()).collect()
    assert sorted((r.doc_id or 0, bytes(r.decoded).decode(), r.k) for r in back) == sorted((d or 0, t or "", k) for d, t, k in EDGE)
    assert bpe.encode(df.limit(0), "text", *catalog.vocabulary()).count() == 0


def groups(texts):
    rolling = neardup.Rolling()
    sets = [neardup.shingles(rolling, t or "") for t in texts]
    head = list(range(len(texts)))

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if neardup.similarity(sets[a], sets[b]) >= neardup.THRESHOLD:
                x, y = find(a), find(b)
                head[max(x, y)] = min(x, y)
    return [find(x) for x in range(len(texts))]


def test_probability_jaccard_is_its_definition():
    rnd = np.random.default_rng(1)
    for _ in range(50):
        a, b = ({int(i): float(rnd.uniform(0.5, 4)) for i in rnd.choice(12, 8, replace=False)} for _ in "ab")
        want = sum(
            1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in a.keys() | b.keys()) for i in a.keys() & b.keys()
        )
        pack = lambda d: (np.array(sorted(d), np.uint64), np.array([d[i] for i in sorted(d)]))
        assert neardup.similarity(pack(a), pack(b)) == pytest.approx(want)


def test_signatures_estimate_it():
    rnd = np.random.default_rng(2)
    hashes = np.unique(rnd.integers(0, 2**63, 300).astype(np.uint64))
    a, b = (hashes[:220], rnd.uniform(1, 3, 220)), (hashes[60:], rnd.uniform(1, 3, len(hashes) - 60))
    runs = []
    for salt in range(40):
        one, two = neardup.signatures([(neardup.mixed(h + np.uint64(salt)), w) for h, w in (a, b)])
        runs.append((one == two).mean())
    assert np.mean(runs) == pytest.approx(neardup.similarity(a, b), abs=0.03)


def test_near_duplicates(spark):
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(4000)]
    texts = []
    for copies in (120, 30, 6, 1, 0, 0):
        # Copies are similar to the text they come from, and not to each other.
        base = [rnd.choice(vocab) for _ in range(300)]
        texts.append(" ".join(base))
        for _ in range(copies):
            words = list(base)
            for _ in range(6):
                words[rnd.randrange(300)] = rnd.choice(vocab)
            texts.append(" ".join(words))
    texts += [texts[3], texts[3], "a short text", "a short text", "another"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.k: r.class_id for r in neardup.classes(df, "doc_id", "text").collect()}
    assert [got[i] for i in range(len(texts))] == groups(texts)
    assert sorted(r.doc_id for r in neardup.keep_one(df, "doc_id", "text").collect()) == sorted(set(groups(texts)))


def altered(rnd, words, n):
    """``words`` with ``n`` of them replaced, far from each other."""
    words = list(words)
    for i in rnd.sample(range(0, len(words), 6), n):
        words[i] = f"x{rnd.random()}"
    return words


def test_near_duplicates_whose_original_is_missing(spark):
    rnd = random.Random(8)
    base = [f"w{rnd.randrange(4000)}" for _ in range(300)]
    # Some variants are similar to each other, some to a few others, some to none; windows of a text make a chain.
    texts = [" ".join(altered(rnd, base, rnd.choice((2, 3, 4, 5, 6)))) for _ in range(60)]
    long = [f"c{i}" for i in range(1100)]
    texts += [" ".join(long[i * 20 : i * 20 + 300]) for i in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.k: r.class_id for r in neardup.classes(df, "doc_id", "text").collect()}
    assert [got[i] for i in range(len(texts))] == groups(texts)


def test_all_of_one_bucket_meet(spark):
    rnd = random.Random(9)
    texts = []
    for n in range(12):
        one = [f"p{n}-{i}" for i in range(100)]
        texts += [" ".join(one), " ".join(altered(rnd, one, 1))]
    long = [f"c{i}" for i in range(400)]
    texts += [" ".join(long[i * 8 : i * 8 + 100]) for i in range(12)] + ["nothing like the others"]
    docs = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "k long, v int, t string")
    signed = neardup._sign(docs).withColumn("bands", F.expr("array(1L)"))
    signed = stage(signed, "signed")
    labels = neardup._links(signed, signed.select("g", "k", "v"), docs)
    rows = signed.join(labels.withColumnRenamed("node", "g"), "g", "left").select("k", F.coalesce("label", "g").alias("x")).collect()
    first = {}
    for r in sorted(rows):
        first.setdefault(r.x, r.k)
    got = {r.k: first[r.x] for r in rows}
    assert [got[i] for i in range(len(texts))] == groups(texts)


@pytest.mark.parametrize("with_original", [True, False])
def test_blocks_of_a_large_bucket_meet(spark, monkeypatch, with_original):
    monkeypatch.setattr(neardup, "BLOCK", 5)
    rnd = random.Random(12)
    base = [f"w{rnd.randrange(4000)}" for _ in range(240)]
    # Most variants are similar to few others or to none, all share bands with many.
    texts = [" ".join(altered(rnd, base, rnd.choice((1, 3, 5, 6, 7)))) for _ in range(90)] + [" ".join(base)] * with_original
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in enumerate(texts)], "doc_id long, text string, n int, label int, bucket int")
    got = {r.k: r.class_id for r in neardup.classes(df, "doc_id", "text").collect()}
    assert [got[i] for i in range(len(texts))] == groups(texts)
    kept = neardup.keep_one(df, "doc_id", "text")
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(groups(texts)))


def test_pairs_just_over_the_threshold_are_found(spark):
    rnd = random.Random(13)
    texts = []
    for n in range(300):
        words = [f"d{n}-{rnd.randrange(4000)}" for _ in range(240)]
        texts += [" ".join(words), " ".join(altered(rnd, words, rnd.choice((3, 4, 5))))]
    rolling = neardup.Rolling()
    sets = [neardup.shingles(rolling, t) for t in texts]
    near = [n for n in range(300) if 0.8 <= neardup.similarity(sets[2 * n], sets[2 * n + 1]) < 0.85]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.k: r.class_id for r in neardup.classes(df, "doc_id", "text").collect()}
    found = [n for n in near if got[2 * n] == got[2 * n + 1]]
    print("recall", len(found), "of", len(near))
    assert len(near) > 50 and len(found) >= 0.99 * len(near)


def test_near_duplicates_of_given_documents(spark):
    rows = documents()
    got = {r.doc_id: r.class_id for r in catalog.op1_neardup(spark, SF).collect()}
    heads = groups([t for _, t in rows])
    assert [got[d] for d, _ in rows] == [rows[h][0] for h in heads]


def test_near_duplicate_edges(spark):
    df = spark.createDataFrame(EDGE, SCHEMA)
    rows = neardup.classes(df, "doc_id", "text").collect()
    assert len(rows) == len(EDGE)
    assert {r.k: r.class_id for r in rows} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5, None: None, 7: 7}
    kept = neardup.keep_one(df, "doc_id", "text")
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7]
    assert neardup.classes(df.limit(0), "doc_id", "text").count() == 0


def test_texts_of_separators_only_have_no_words(spark):
    texts = ["\x1c", " \x1d\x1e ", "\x1f\n", "\x85", "\u3000", "", "two words", "two\x1cwords"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = neardup.classes(df, "doc_id", "text").collect()
    assert sorted((r.k, r.class_id, r.class_size) for r in rows) == [(i, i, 1) for i in range(6)] + [(6, 6, 2), (7, 6, 2)]
    assert sorted(r.doc_id for r in neardup.keep_one(df, "doc_id", "text").collect()) == [0, 1, 2, 3, 4, 5, 6]


def cut_by_hand(rows, length):
    words = [re.findall("[^\x20\x09-\x0d]+", t or "") for _, t in rows]
    seen = collections.Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for (d, _), w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_substrings(spark):
    rnd = random.Random(4)
    vocab = [f"v{i}" for i in range(300)]
    say = lambda n: [rnd.choice(vocab) for _ in range(n)]
    passages = [say(n) for n in (34, 35, 36, 60, 200, 20)]
    rows = []
    for d in range(60):
        w = say(rnd.randint(0, 120))
        for p in rnd.sample(passages, 2):
            cut = rnd.randint(0, 5)
            w += p[cut : len(p) - rnd.randint(0, 5)] + say(rnd.randint(0, 9))
        rows.append((d, "\n ".join(w)))
    rows += [(60, "again and " * 60), (61, rows[0][1]), (62, " ".join(passages[4] * 2)), (63, None), (64, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, substring.digests(df, "doc_id", "text", 35).collect())) == cut_by_hand(rows, 35)
    kept = {r.doc_id: r.text for r in substring.remove(df, "doc_id", "text", 35).collect()}
    for d, _, _, digest in cut_by_hand(rows, 35):
        assert hashlib.sha256(" ".join(kept[d].split()).encode()).hexdigest() == digest


def test_substrings_of_given_documents(spark):
    assert sorted(map(tuple, catalog.op7_substring(spark, SF).collect())) == sorted(cut_by_hand(documents(), 35))


def test_substring_edges(spark):
    df = spark.createDataFrame(EDGE, SCHEMA)
    rows = {(r.doc_id, r.n_words, r.n_removed) for r in substring.digests(df, "doc_id", "text", 5).collect()}
    assert rows == {(1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 2, 0), (5, 6, 6), (6, 6, 6), (None, 8, 0), (7, 30000, 30000)}
    assert substring.remove(df, "doc_id", "text", 5).columns == df.columns
    assert substring.digests(df.limit(0), "doc_id", "text", 5).count() == 0


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    rows = catalog.op10_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    right = {label: [r.predicted == label for r in rows if r.quality == label] for label in (0, 1)}
    assert all(np.mean(x) >= 0.97 for x in right.values())
    assert all(0 <= r.score <= 1 for r in rows)


def test_quality_edges(spark):
    df = spark.createDataFrame(EDGE, SCHEMA)
    labels = spark.createDataFrame([(4, 1), (4, 1), (5, 0), (7, None), (99, 1), (None, 0)], "doc_id long, quality int")
    model = quality.fit(df, labels, "doc_id", "text", "quality")
    rows = quality.score(df, "text", model).collect()
    assert len(rows) == len(EDGE) and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in rows if r.doc_id in (1, 2)} == {0.0}
    none = quality.fit(df, labels.limit(0), "doc_id", "text", "quality")
    assert none is None and {r.score for r in quality.score(df, "text", none).collect()} == {0.5}
