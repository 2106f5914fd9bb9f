"""Requirements in retrieved context, answers checked against their sources, test plans and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.functions.text import quote
from clauseloom.plans.ordered import SEGMENT_ROWS, ordinal, segment_of
from clauseloom.schemas import TEST_PLAN

# Word groups of context requirements, first match wins.
REQUIREMENT_WORDS = {
    "mandatory": ["shall", "must", "required", "mandatory"],
    "recommended": ["should", "recommended", "advisable"],
    "optional": ["may", "optional", "permitted"],
}
# Priority of a requirement's test.
PRIORITY = {"mandatory": "critical", "prohibition": "high", "recommendation": "medium", "permission": "low"}
# Standard and the tests it belongs to.
TEST_TYPES = [
    ("CISPR 32", "radiated_emissions"),
    ("CISPR 32", "conducted_emissions"),
    ("IEC 61000-4-3", "radiated_immunity"),
    ("IEC 61000-4-6", "conducted_immunity"),
    ("IEC 61000-4-2", "electrostatic_discharge"),
    ("IEC 61000-4-4", "electrical_fast_transient"),
    ("IEC 61000-4-5", "surge"),
    ("IEC 61000-4-11", "voltage_dip_interruption"),
    ("IEC 61000-3-2", "harmonics"),
    ("IEC 61000-3-3", "flicker"),
]
# Phrases that ask for a test plan, and greetings.
TEST_PLAN_PHRASES = [
    "test plan", "testing plan", "test procedure", "test setup",
    "how to test", "testing procedure", "create a test", "generate test",
    "test case", "test cases", "test method", "test specification",
    "verification plan", "validation plan", "compliance test",
    "emc test", "emc testing", "immunity test", "emission test",
]
GREETINGS = [
    "hello", "hi", "hey", "greetings", "good morning", "good afternoon",
    "good evening", "howdy", "hola", "yo", "hi there", "hello there",
]


def _any(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, {quote(w)})" for w in words) + ")"


def classify_requirements(context: DataFrame, words: dict[str, list[str]] = REQUIREMENT_WORDS) -> DataFrame:
    """Context rows ``(query_id, rank, uid, content)`` that hold a requirement, numbered in context order."""
    cases = " ".join(f"WHEN {_any('_low', group)} THEN {quote(kind)}" for kind, group in words.items())
    typed = (
        context.selectExpr("query_id", "rank", "uid", "content", "lower(content) AS _low")
        .selectExpr("query_id", "rank", "uid AS source_chunk_id", f"CASE {cases} END AS requirement_type",
                    "substring(content, 1, 500) AS description", f"{segment_of('rank')} AS _seg")
        .filter("requirement_type IS NOT NULL")
    )
    return ordinal(typed, ["query_id"], ["_seg"], ["rank"], "n").selectExpr(
        "query_id", "format_string('REQ_%03d', n) AS requirement_id", "source_chunk_id", "requirement_type", "description"
    )


def requirements_by_type(requirements: DataFrame, key: str, types, col: str = "type") -> DataFrame:
    """Count per type, zeros kept."""
    return requirements.groupBy(key).agg(*[F.expr(f"count_if({col} = {quote(t)})").alias(t) for t in types])


def extract_json(df: DataFrame, col: str, schema: str = TEST_PLAN) -> DataFrame:
    """``json``: the text from the first ``{`` to the last ``}``; ``parsed``: its value, null when broken."""
    return df.selectExpr("*", rf"nullif(regexp_extract({col}, r'(?s)\{{.*\}}', 0), '') AS json").selectExpr(
        "*", f"CASE WHEN try_parse_json(json) IS NOT NULL THEN from_json(json, {quote(schema)}) END AS parsed"
    )


def test_cases(plans: DataFrame) -> DataFrame:
    """Case rows of parsed plans ``(query_id, parsed)`` with their defaults."""
    none = "CAST(array() AS ARRAY<STRING>)"
    return plans.filter("parsed IS NOT NULL").selectExpr("query_id", "posexplode(parsed.test_cases) AS (pos, tc)").selectExpr(
        "query_id", "pos", "coalesce(tc.id, format_string('TC_%03d', pos + 1)) AS id",
        "coalesce(tc.source_requirement, '') AS source_requirement",
        "coalesce(tc.requirement_type, 'informative') AS requirement_type",
        "coalesce(tc.procedure, '') AS procedure", "coalesce(tc.pass_criteria, '') AS pass_criteria",
        f"coalesce(tc.equipment_required, {none}) AS equipment_required",
        f"coalesce(tc.source_chunks, {none}) AS source_chunks",
    )


def source_warnings(plans: DataFrame, context: DataFrame) -> DataFrame:
    """One row per cited id that is not in the plan's context, at plan level and at case level."""
    cited = plans.filter("parsed IS NOT NULL").selectExpr(
        "query_id",
        "explode(concat("
        "transform(coalesce(parsed.sources_used, array()), s -> struct(CAST(NULL AS STRING) AS case_id, s AS source)),"
        # A case without an id is named by its place, as in test_cases; only the plan level has no case id.
        " flatten(transform(coalesce(parsed.test_cases, array()), (t, i) -> transform(coalesce(t.source_chunks, array()), s ->"
        " struct(coalesce(t.id, format_string('TC_%03d', i + 1)) AS case_id, s AS source)))))) AS c",
    ).selectExpr("query_id", "c.case_id AS case_id", "c.source AS source")
    known = context.selectExpr("query_id", "uid AS source").distinct()
    return cited.join(known, ["query_id", "source"], "left_anti").selectExpr(
        "query_id", "case_id", "source",
        "CASE WHEN case_id IS NULL THEN concat(\"Referenced source '\", source, \"' not in provided context\")"
        " ELSE concat('Test case ', case_id, \" references unknown source '\", source, \"'\") END AS warning",
    )


def validate_sources(plans: DataFrame, context: DataFrame) -> DataFrame:
    """Per parsed plan the number of warnings and whether there are none."""
    counted = source_warnings(plans, context).groupBy("query_id").agg(F.count("*").alias("n"))
    return plans.filter("parsed IS NOT NULL").select("query_id").join(counted, "query_id", "left").selectExpr(
        "query_id", "coalesce(n, 0) AS warnings", "n IS NULL AS is_valid"
    )


def plan_audit(context: DataFrame) -> DataFrame:
    """One row per chunk of a plan's context, in its order: whether it is a seed or came by expansion, and how many there are."""
    total = context.groupBy("query_id").agg(F.count("*").alias("total_context_chunks"))
    return context.join(total, "query_id").selectExpr(
        "query_id", "rank", "uid AS chunk_id", "CASE WHEN score > 0 THEN 'seed' WHEN score = 0 THEN 'expanded' END AS role", "total_context_chunks",
    )


def groundedness(
    texts: DataFrame, context: DataFrame, threshold: float = 0.3, key: str = "text_id", on: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """How much of each text is covered by its context.

    ``texts(key, text)``, ``context(content)``; with ``on`` both carry that column and a text is compared
    with the context rows that share it, else with all of them. Returns ``(scores, flagged sentences)``.

    Words meet in a join. A sentence counts a word once, and every word row carries its sentence, so a
    frequent word is split by the skew join and both counts combine on the map side.
    """
    keep = [key, *([on] if on and on != key else [])]
    cut = rf"split(regexp_replace(text, r'([.?])', '$1|'), r'\|')"
    sent = (
        texts.selectExpr(*keep, rf"posexplode(filter(transform({cut}, s -> regexp_replace(s, r'^\s+|\s+$', '')), s -> s <> '')) AS (sentence_no, sentence)")
        .selectExpr("*", r"array_distinct(filter(split(lower(sentence), r'\s+'), w -> w <> '')) AS words")
    )
    words = sent.selectExpr(*keep, "sentence_no", "explode(words) AS word")
    group = [on] if on else []
    known = (
        context.selectExpr(*group, r"explode(array_distinct(split(lower(content), r'\s+'))) AS word")
        .filter("word <> ''")
        .distinct()
    )
    hits = words.join(known, [*group, "word"], "left_semi").groupBy(key, "sentence_no").agg(F.count("*").alias("hits"))
    judged = sent.select(key, "sentence_no", "sentence", F.size("words").alias("n")).join(
        hits, [key, "sentence_no"], "left"
    ).selectExpr(key, "sentence_no", "sentence", f"n > 0 AND coalesce(hits, 0) / n >= {threshold}D AS grounded")
    scores = (
        texts.select(key)
        .join(
            judged.groupBy(key).agg(F.expr("count_if(grounded)").alias("grounded"), F.count("*").alias("sentences")),
            key, "left",
        )
        .selectExpr(
            key, "coalesce(grounded, 0) AS grounded", "coalesce(sentences, 0) AS sentences",
            "coalesce(grounded / nullif(sentences, 0), 0D) AS score",
        )
    )
    return scores, judged.filter("NOT grounded").drop("grounded")


def requirement_priority(requirements: DataFrame, col: str = "type") -> DataFrame:
    cases = " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in PRIORITY.items())
    return requirements.selectExpr("*", f"CASE {col} {cases} END AS priority")


def coverage_matrix(requirements: DataFrame, cases: DataFrame) -> DataFrame:
    """Per requirement how many cases cover it, the first of them, and the status. The pairs themselves stay
    in ``cases(requirement_id, test_case_id)``, where a requirement may have any number of rows."""
    per = (
        cases.select("requirement_id", "test_case_id").distinct()
        .groupBy("requirement_id")
        .agg(F.count("*").alias("n_tests"), F.min("test_case_id").alias("first_test"))
    )
    return requirements.join(per, "requirement_id", "left").selectExpr(
        *requirements.columns, "coalesce(n_tests, 0) AS n_tests", "first_test",
        "CASE WHEN n_tests > 0 THEN 'covered' ELSE 'not_covered' END AS coverage_status",
    )


def covered_by(requirements: DataFrame, cases: DataFrame) -> DataFrame:
    """One row per requirement and case that covers it."""
    return cases.select("requirement_id", "test_case_id").distinct().join(requirements.select("requirement_id").distinct(), "requirement_id", "left_semi")


def coverage_summary(matrix: DataFrame) -> DataFrame:
    return matrix.agg(
        F.count("*").alias("total_requirements"),
        F.expr("count_if(n_tests > 0)").alias("covered_requirements"),
        F.expr("count_if(n_tests = 0)").alias("not_covered"),
    ).selectExpr(
        "*", "coalesce(round(100D * covered_requirements / nullif(total_requirements, 0), 1), 0D) AS coverage_percentage"
    )


def test_type_lookup(refs: DataFrame, col: str = "standard") -> DataFrame:
    """Test types of each standard reference; a reference may name a part, an edition or a date behind it."""
    # The standard number is cut out of both sides, so that this is an equi-join and no prefix comparison.
    number = r"regexp_replace(regexp_extract(upper({}), r'^\s*([A-Z/]+\s*\d+(?:-\d+)*)', 1), r'\s+', '')"
    table = refs.sparkSession.createDataFrame(TEST_TYPES, "known string, test_type string").selectExpr(
        f"{number.format('known')} AS _std", "test_type"
    )
    return refs.selectExpr("*", f"{number.format(col)} AS _std").join(F.broadcast(table), "_std", "left").selectExpr(
        *refs.columns, "coalesce(test_type, 'other') AS test_type"
    )


def plan_rollup(cases: DataFrame, plans: DataFrame) -> DataFrame:
    """Per plan the number of cases, pieces of equipment and sources, each distinct."""
    counted = cases.groupBy("query_id").agg(F.count("*").alias("total_test_cases"))
    gear = cases.selectExpr("query_id", "explode(equipment_required) AS x").distinct().groupBy("query_id").agg(F.count("*").alias("equipment"))
    used = plans.filter("parsed IS NOT NULL").selectExpr("query_id", "explode(parsed.sources_used) AS x").distinct().groupBy("query_id").agg(F.count("*").alias("sources"))
    base = plans.filter("parsed IS NOT NULL").selectExpr("query_id", "coalesce(parsed.applicable_standard, '') AS applicable_standard")
    return (
        base.join(counted, "query_id", "left").join(gear, "query_id", "left").join(used, "query_id", "left")
        .selectExpr("query_id", "applicable_standard", *[f"coalesce({c}, 0) AS {c}" for c in ("total_test_cases", "equipment", "sources")])
    )


def message_intent(messages: DataFrame, col: str, phrases=TEST_PLAN_PHRASES, greetings=GREETINGS) -> DataFrame:
    """``is_test_plan_request``: a phrase occurs; ``is_greeting``: the text without punctuation is a greeting."""
    plain = rf"regexp_replace(regexp_replace(lower({col}), r'^\s+|\s+$', ''), r'[^\p{{L}}\p{{N}}_\s]', '')"
    listed = ", ".join(quote(g) for g in greetings)
    return messages.selectExpr(
        "*", f"{_any(f'lower({col})', phrases)} AS is_test_plan_request", f"{plain} IN ({listed}) AS is_greeting"
    )
