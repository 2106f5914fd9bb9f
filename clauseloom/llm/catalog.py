"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.llm import ann, bpe, html, merkle, mixing, neardup, quality, secrets, sharding, substring, topk, warc, whitening
from clauseloom.llm.common import table

#: Bytes of text in a shard at most.
SHARD_BYTES = 1 << 20

#: White-space runs part the words that the mixture counts.
WORD = "[^ \\t\\n\\r\\f\\x0B]+"

#: Weights of the mixture; what is not named counts 1.
WEIGHTS = {"lang": {"en": 4.0, "de": 2.0, "fr": 2.0}}
EPOCHS = 3
SEED = 7


def op1_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.classes(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.drop("v").withColumnRenamed("k", "doc_id")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), "doc_id", "text", SHARD_BYTES)


def vocabulary() -> tuple[bytes, str]:
    """The public vocabulary of 50,256 byte-level tokens and its pattern."""
    import public_tokenizers

    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", *vocabulary())


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 20 == 0, 20)


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.transform("v", lambda x: F.floor(x * 256))
    return topk.top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", whole, F.col("vec_id") % 50 == 0, 5)


def with_domain(docs: DataFrame) -> DataFrame:
    """Five neighbouring sources form a domain."""
    number = F.regexp_extract(F.coalesce("source", F.lit("")), "([0-9]+)$", 1)
    return docs.withColumn(
        "domain", F.when(number == "", F.lit("none")).otherwise(F.concat(F.lit("d"), F.expr(f"CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) DIV 5")))
    )


def mixed(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    return mixing.mix(
        with_domain(docs), "doc_id", F.expr(f"regexp_count(text, r'{WORD}')"), ["domain", "lang", "source"],
        WEIGHTS, max_epochs=EPOCHS, seed=SEED, carry=carry,
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


#: Words of a window that must not occur twice.
REPEAT_WORDS = 35


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(table(spark, sf_dir, "documents"), "doc_id", "text", REPEAT_WORDS)


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), "page_id", "url", "html")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"), "page_id", "url", "html")


#: Documents that score less are of low quality.
GOOD = 0.7


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.Voters | None:
    """Learned from labelled documents outside the held-out quarter."""
    labels = table(spark, sf_dir, "labels").filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    return quality.fit(docs, labels, "doc_id", "text", "quality")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs.select("doc_id", "text"), "text", quality_model(spark, docs, sf_dir), ("text",))
    return scored.select(
        "doc_id", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out"), "score",
        (F.col("score") >= GOOD).cast("int").alias("predicted"),
    )


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", drop=("text",))


#: Components of a whitened embedding.
COMPONENTS = 16


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", COMPONENTS)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh hash of a document number is tampered with: one character more is claimed."""
    one_more = F.col("n_chars").cast("decimal(38,0)") + 1
    return merkle.manifest(
        table(spark, sf_dir, "documents"), "doc_id", "lang", ["doc_id", "source", "lang", "n_chars", "text"], {"n_chars": one_more},
        F.crc32(F.col("doc_id").cast("string")) % 7 == 0,
    ).withColumnRenamed("k", "doc_id")


QUERIES = {
    "op1_neardup": op1_neardup,     "op2_sharding": op2_sharding, "op3_bpe": op3_bpe, "op4_ann": op4_ann,
    "op5_topk": op5_topk, "op6_mixing": op6_mixing,
    "op7_substring": op7_substring, "op8_html": op8_html, "op9_warc": op9_warc, "op10_quality": op10_quality,
    "op11_secrets": op11_secrets, "op12_whitening": op12_whitening, "op13_merkle": op13_merkle,
}

_OP2 = f"""
WITH rows AS (
  SELECT doc_id, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h,
    CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes FROM documents),
levels AS (SELECT rows.*, d, h >> (60 - d) AS q FROM rows, range(0, 61) AS t(d)),
buckets AS (
  SELECT d, q, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_rows FROM levels GROUP BY d, q
  HAVING sum(n_bytes) <= {SHARD_BYTES} OR count(*) = 1),
placed AS (
  SELECT l.doc_id, l.n_bytes, l.d, l.q, b.shard_bytes, b.shard_rows,
    row_number() OVER (PARTITION BY l.doc_id ORDER BY l.d) AS nth
  FROM levels l JOIN buckets b USING (d, q))
SELECT doc_id, n_bytes, CASE WHEN d = 0 THEN '' ELSE right(lpad(bin(q), 60, '0'), d) END AS shard, CAST(d AS INT) AS depth,
  shard_bytes, shard_rows, CAST(max(d) OVER () AS INT) AS global_depth
FROM placed WHERE nth = 1
"""


def _fill(name: str, path: str, up: str, cap: str, budget: str, weight: str, level: str) -> str:
    """One level of the tree: the children's shares of their parents' budgets."""
    part = f"PARTITION BY {up}" if up else ""
    join = f"JOIN {budget} USING ({up})" if up else f", {budget}"
    return f"""
{name}_a AS (SELECT {path}, sum(capacity) AS cap FROM {cap} GROUP BY {path}),
{name}_b AS (SELECT a.*, given AS whole, {weight} AS w, cap / ({weight}) AS full_at FROM {name}_a a {join}),
{name}_c AS (
  SELECT *, (whole - coalesce(sum(cap) OVER ({part} ORDER BY full_at, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER ({part} ORDER BY full_at, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS here FROM {name}_b),
{name}_d AS (
  SELECT *, first_value(CASE WHEN full_at > here THEN here END IGNORE NULLS) OVER ({part} ORDER BY full_at, {level}
    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lev FROM {name}_c),
{name} AS (
  SELECT {path}, CAST(least(cap, CASE WHEN lev IS NULL OR full_at <= lev THEN cap ELSE floor(w * lev + 1e-6) END) AS BIGINT) AS given
  FROM {name}_d)"""


_LANG = "CASE " + " ".join(f"WHEN lang = '{k}' THEN {v!r}" for k, v in WEIGHTS["lang"].items()) + " ELSE 1.0 END"
_OP6 = rf"""
WITH docs AS (
  SELECT doc_id, CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) = '' THEN 'none'
      ELSE 'd' || (CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) // 5) END AS domain,
    coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, sum(n_tokens) * {EPOCHS}.0::DOUBLE AS capacity FROM docs GROUP BY ALL),
root AS (SELECT CAST(sum(tokens) AS DOUBLE) AS given FROM leaves),
{_fill('g1', 'domain', '', 'leaves', 'root', '1.0', 'domain')},
{_fill('g2', 'domain, lang', 'domain', 'leaves', 'g1', _LANG, 'lang')},
{_fill('g3', 'domain, lang, source', 'domain, lang', 'leaves', 'g2', '1.0', 'source')},
plan AS (
  SELECT domain, lang, source, tokens AS leaf_tokens, given AS leaf_budget, CASE WHEN tokens > 0 THEN given // tokens ELSE 0 END AS epochs,
    CASE WHEN tokens > 0 THEN given % tokens ELSE 0 END AS rest FROM leaves JOIN g3 USING (domain, lang, source)),
ranked AS (
  SELECT docs.*, leaf_tokens, leaf_budget, epochs, rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source
    ORDER BY substr(md5('{SEED}/' || epochs || '/' || doc_id), 1, 15) ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM docs JOIN plan USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, leaf_tokens, leaf_budget,
  CAST(epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS INT) AS copies FROM ranked
"""

_OP5 = """
WITH rows AS (
  SELECT vec_id, [CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM rows q JOIN rows c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

_OP9 = f"""
WITH rows AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
heads AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS head FROM rows)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {warc.REVISIT_BYTES} AND page_id <> head THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {warc.REVISIT_BYTES} AND page_id <> head THEN head END AS refers_to FROM heads
"""

_CRC = """list_reduce([4294967295::UBIGINT] || [CAST(ascii(c) AS UBIGINT) FOR c IN string_split(CAST(doc_id AS VARCHAR), '')],
    lambda crc, b: list_reduce([xor(crc, b)] || [0::UBIGINT FOR i IN range(8)], lambda x, i: xor(x >> 1, 3988292384::UBIGINT * (x & 1))))"""
_LEAF = "sha256(" + " || ".join(
    f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "{n_chars}", "text")
) + ")"
_OP13 = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, lang, {_LEAF.format(n_chars="n_chars")} AS leaf,
    CASE WHEN xor({_CRC}, 4294967295::UBIGINT) % 7 = 0 THEN {_LEAF.format(n_chars="(n_chars::HUGEINT + 1)")} END AS altered FROM documents),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM docs),
groups AS (SELECT lang, count(*) AS n, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM docs GROUP BY lang),
placed AS (SELECT r.*, g.tree, g.n FROM ranked r JOIN groups g ON r.lang IS NOT DISTINCT FROM g.lang),
low AS (
  SELECT tree, 0 AS lev, pos, leaf AS h, n FROM placed
  UNION ALL
  SELECT tree, lev + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM low WHERE n > 1 GROUP BY tree, lev, pos // 2, n),
high AS (
  SELECT 0 AS lev, tree AS pos, h, count(*) OVER () AS n FROM low WHERE n = 1
  UNION ALL
  SELECT lev + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM high WHERE n > 1 GROUP BY lev, pos // 2, n),
steps AS (
  SELECT p.doc_id, p.tree, p.pos, l.lev, (p.pos >> l.lev) & 1 AS is_right, s.h FROM placed p
  JOIN (SELECT DISTINCT tree, lev FROM low WHERE n > 1) l ON l.tree = p.tree
  LEFT JOIN low s ON s.tree = p.tree AND s.lev = l.lev AND s.pos = xor(p.pos >> l.lev, 1)
  UNION ALL
  SELECT p.doc_id, p.tree, p.pos, 100 + l.lev, (p.tree >> l.lev) & 1, s.h FROM placed p
  JOIN (SELECT DISTINCT lev FROM high WHERE n > 1) l ON true
  LEFT JOIN high s ON s.lev = l.lev AND s.pos = xor(p.tree >> l.lev, 1)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY tree, pos ORDER BY lev) AS nth FROM steps),
proofs AS (SELECT tree, pos, sha256(coalesce(string_agg(h, '' ORDER BY nth), '')) AS proof_sha256, max(nth) AS last FROM numbered GROUP BY tree, pos),
fold AS (
  SELECT tree, pos, 0::BIGINT AS nth, coalesce(altered, leaf) AS h FROM placed
  UNION ALL
  SELECT f.tree, f.pos, s.nth, sha256(CASE WHEN s.is_right = 1 THEN s.h || f.h ELSE f.h || coalesce(s.h, '') END)
  FROM fold f JOIN numbered s ON s.tree = f.tree AND s.pos = f.pos AND s.nth = f.nth + 1)
SELECT p.doc_id, p.leaf, sub.h AS subroot, top.h AS root, coalesce(pr.proof_sha256, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = top.h AS verified
FROM placed p JOIN low sub ON sub.tree = p.tree AND sub.n = 1 JOIN high top ON top.n = 1
LEFT JOIN proofs pr ON pr.tree = p.tree AND pr.pos = p.pos
JOIN fold f ON f.tree = p.tree AND f.pos = p.pos AND f.nth = coalesce(pr.last, 0)
"""

SQL = {"op2_sharding": _OP2, "op5_topk": _OP5, "op6_mixing": _OP6, "op9_warc": _OP9, "op13_merkle": _OP13}
