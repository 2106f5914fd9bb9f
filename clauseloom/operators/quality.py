"""Rules that chunks and registry rows must meet. Each rule is a column or a join; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.functions import ids
from clauseloom.schemas import CONTENT_TYPES, DOCUMENT_STATES, REQUIREMENT_TYPES

# The messages of the gate.
STAGE_ERRORS = {
    "1": "Stage 1 failed: Missing required keys (chunk_id, document_metadata, content)",
    "2": "Stage 2 failed: Parent node does not exist",
    "3": "Stage 3 failed: Invalid type enum values",
}


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


#: The document a chunk of either form belongs to.
DOCUMENT = "coalesce(nullif(document_metadata.id, ''), document_id, '')"


def check_structural(chunks: DataFrame) -> DataFrame:
    """``structural_ok``: the keys are there and the chunk holds something."""
    return chunks.selectExpr(
        "*",
        "chunk_id IS NOT NULL AND document_metadata IS NOT NULL AND"
        " (coalesce(size(content), 0) > 0 OR coalesce(size(tables), 0) > 0 OR coalesce(size(figures), 0) > 0)"
        " AS structural_ok",
    )


def check_enums(chunks: DataFrame) -> DataFrame:
    """``enums_ok``: requirement and content types are known ones."""
    return chunks.selectExpr(
        "*",
        f"forall(coalesce(enrichment.requirements, array()), r -> coalesce(r.type IN {_in(REQUIREMENT_TYPES)}, false))"
        f" AND forall(coalesce(content, array()), c -> coalesce(c.type IN {_in(CONTENT_TYPES)}, false)) AS enums_ok",
    )


def check_referential(chunks: DataFrame, existing_uids: DataFrame | None = None) -> DataFrame:
    """``parent_ok``: the parent is in the graph or in this batch, or there is none."""
    batch = chunks.selectExpr(f"{ids.clause_uid(DOCUMENT, ids.clause_of_chunk('chunk_id'))} AS _uid")
    known = batch if existing_uids is None else batch.unionByName(existing_uids.selectExpr("uid AS _uid"))
    wanted = f"CASE WHEN coalesce(hierarchy.parent_id, '') <> '' THEN {ids.clause_uid(DOCUMENT, 'hierarchy.parent_id')} END"
    found = known.distinct().selectExpr("_uid AS _parent", "true AS _found")
    return (
        chunks.selectExpr("*", f"{wanted} AS _parent")
        .join(found, "_parent", "left")
        .selectExpr("* EXCEPT (_parent, _found)", "_parent IS NULL OR _found IS NOT NULL AS parent_ok")
    )


def validation_gate(
    chunks: DataFrame, existing_uids: DataFrame | None = None, stage: str = "all", flat_passes: bool = True
) -> DataFrame:
    """``error``: the message of the first stage that fails, or null.

    A chunk of the flat form, one with ``document_id`` and ``chunk_id`` at top level, passes unseen as
    long as ``flat_passes`` is set.
    """
    if stage not in ("all", "1", "2", "3"):
        raise ValueError("stage must be all, 1, 2 or 3")
    checked = check_referential(check_enums(check_structural(chunks)), existing_uids)
    columns = {"1": "structural_ok", "2": "parent_ok", "3": "enums_ok"}
    run = columns if stage == "all" else {stage: columns[stage]}
    cases = " ".join(f"WHEN NOT {col} THEN '{STAGE_ERRORS[s]}'" for s, col in run.items())
    flat = "WHEN coalesce(document_id, '') <> '' AND coalesce(chunk_id, '') <> '' THEN NULL " if flat_passes else ""
    return checked.selectExpr("* EXCEPT (structural_ok, parent_ok, enums_ok)", f"CASE {flat}{cases} END AS error")


def document_gate(gated: DataFrame) -> DataFrame:
    """Per document the chunks passed and failed. One failed chunk fails the document."""
    return (
        gated.groupBy(F.expr(DOCUMENT).alias("document_id"))
        .agg(F.expr("count_if(error IS NULL)").alias("passed"), F.expr("count_if(error IS NOT NULL)").alias("failed"))
        .selectExpr(
            "*", "failed = 0 AS accepted",
            "CASE WHEN failed > 0 THEN concat('Validation failed: ', failed, ' chunks invalid') END AS error_message",
        )
    )


def accepted_chunks(chunks: DataFrame, gate: DataFrame) -> DataFrame:
    """The chunks of documents that passed the gate."""
    failed = gate.filter("NOT accepted").select(F.col("document_id").alias("_doc"))
    return chunks.join(failed, F.expr(f"{DOCUMENT} = _doc"), "left_anti")


def _violations(df: DataFrame, key: str, rules: dict[str, str]) -> DataFrame:
    """One row per broken rule. A rule is the condition that must hold."""
    tests = ", ".join(f"CASE WHEN NOT coalesce({cond}, false) THEN '{name}' END" for name, cond in rules.items())
    return df.selectExpr(f"CAST({key} AS STRING) AS key", f"explode(array_compact(array({tests}))) AS rule")


def document_rules(documents: DataFrame) -> DataFrame:
    return _violations(
        documents, "id",
        {
            "hash_length": "length(hash) = 64",
            "status_known": f"status IN {_in(DOCUMENT_STATES)}",
            "filename_length": "length(filename) <= 512",
        },
    )


def clause_rules(clauses: DataFrame) -> DataFrame:
    return _violations(
        clauses, "concat(document_id, ':', clause_id)",
        {
            "clause_id_pattern": r"regexp_like(clause_id, r'(?i)^([A-Z]|\d+)(?:\.(\d+))*$')",
            "document_id_length": "length(document_id) >= 3",
        },
    )


def chunk_rules(chunks: DataFrame) -> DataFrame:
    return _violations(
        chunks, "chunk_id",
        {"chunk_id_has_colon": "contains(chunk_id, ':')", "level_range": "level BETWEEN 0 AND 10"},
    )


def unique_uids(nodes: DataFrame) -> DataFrame:
    """Ids that occur more than once under one label."""
    return nodes.groupBy("label", "uid").agg(F.count("*").alias("n")).filter("n > 1")


def fk_violations(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows whose parent is missing. A null key refers to nothing and is no violation."""
    keys = parents.selectExpr(f"{parent_key} AS _key").distinct()
    return children.filter(f"{child_key} IS NOT NULL").join(keys, F.expr(f"{child_key} = _key"), "left_anti")
