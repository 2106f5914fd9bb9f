"""From raw documents to token ids: judge, dedup, cut repeats, mix, encode.

Every stage is a function of a session, the documents that the stage before has kept, and the folder of the tables. It returns documents
with the same columns; the last returns token ids. ``run`` writes each stage's result to the shared folder and reads it again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.llm import bpe, catalog, neardup, quality, substring
from clauseloom.llm.common import table
from clauseloom.plans.stage import stage


def judge(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good ones. It learns from the labelled documents among ``docs``."""
    # A column of this name that the documents have already stays what it was.
    own = {c: f"_own_{i}" for i, c in enumerate(docs.columns) if c.lower() == "score"}
    scored = quality.score(docs.withColumnsRenamed(own), "text", catalog.quality_model(spark, docs, sf_dir))
    return scored.filter(F.col("score") >= catalog.GOOD).drop("score").withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id."""
    return neardup.keep_one(docs, "doc_id", "text")


def cut(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand somewhere else too; a document may be left empty."""
    made = substring.remove(docs, "doc_id", "text", catalog.REPEAT_WORDS)
    if "n_chars" not in docs.columns:
        return made
    return made.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it, which may be never."""
    rows = stage(docs.withColumn("_row", F.monotonically_increasing_id()), "mixing-docs")
    copies = catalog.mixed(rows, ("_row",)).filter("copies > 0").selectExpr("_row", "copies AS _copies")
    return rows.join(copies, "_row").withColumn("_epoch", F.explode(F.sequence(F.lit(1), "_copies"))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and whether the ids decode to the very text."""
    named = docs.select("doc_id", "lang", "source", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    made = bpe.encode(named, "text", *catalog.vocabulary())
    return made.withColumn("exact", F.col("decoded_sha256") == F.col("text_sha256")).drop("decoded_sha256", "text_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", judge),
    ("near-dedup", dedup),
    ("substring dedup", cut),
    ("mixing", mix),
    ("byte-level BPE", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


#: The classifier cannot be said in SQL; a test holds ``run`` against a plain version of every stage.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
