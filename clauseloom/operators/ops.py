"""Logs, metrics and rate limits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.functions.text import quote
from clauseloom.plans.ordered import SEGMENT_ROWS, top_per_key

# The access-log pattern and the paths whose errors are expected.
HTTP_LINE = r'"(\w+)\s+([^\s]+)\s+HTTP[^"]*"\s+(\d{3})'
TEST_PATH = "/test"
NULL_RENAME = "/api/session/null/rename"
SIGNUP_PATH = "/api/auth/signup"
SEVERITY = ("critical", "error", "warning", "info")


def _has(words) -> str:
    return "(" + " OR ".join(f"contains(low, {quote(w)})" for w in words) + ")"


_HTTP = f"regexp_like(line, {quote(HTTP_LINE)})"
# Words that make a line an error or a warning, and the ones that excuse it.
_PROFILES = {
    "server": [
        (_HTTP, None, None),
        ("contains(line, 'Warning:') OR contains(line, 'warning:')", "'warning'", "warning"),
        (f"{_has(['error', 'exception', 'traceback', 'failed', 'fatal'])} AND NOT"
         f" {_has(['200 ok', '304', '301', '302', 'no error'])}", "'error'", "exception"),
    ],
    "container": [
        (f"{_has(['error', 'fatal', 'failed', 'exception', 'refused', 'timeout', 'denied'])} AND"
         f" {_has(['no error', 'error=0', 'without error', 'error_action'])}", None, None),
        (_has(["error", "fatal", "failed", "exception", "refused", "timeout", "denied"]),
         f"CASE WHEN {_has(['fatal', 'critical'])} THEN 'critical' ELSE 'error' END", "container"),
        (_has(["warn", "warning", "deprecated"]), "'warning'", "container"),
    ],
    "container_tail": [
        (f"{_has(['error', 'exception', 'failed', 'fatal', 'critical'])} AND NOT"
         f" {_has(['no error', 'error=0', 'errors: 0', 'without error'])}",
         f"CASE WHEN {_has(['fatal', 'critical'])} THEN 'critical' ELSE 'error' END", "container"),
    ],
    "server_tail": [
        (f"{_has(['error', 'exception', 'traceback', 'failed'])} AND NOT {_has(['no error', 'error=0'])}", "'error'", "log"),
    ],
    "health": [
        ("contains(line, '\" 5') AND contains(low, 'http/1.1\"')", "'error'", "http_error"),
        (_has(["exception", "traceback"]), "'error'", "exception"),
        (_has(["deprecationwarning", "futurewarning"]), "'warning'", "deprecation"),
    ],
}
_CUT = {"server": 300, "container": 300, "container_tail": 500, "server_tail": 500, "health": 200}


def parse_http_errors(lines: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Access-log lines with status 400 and above, without test paths and refused sign-ups. ``keep`` names
    further columns to carry along."""
    part = lambda g: f"regexp_extract(line, {quote(HTTP_LINE)}, {g})"
    return (
        lines.filter(_HTTP)
        .selectExpr("source", "line_no", *keep, f"{part(1)} AS method", f"{part(2)} AS path", f"CAST({part(3)} AS INT) AS status")
        .filter(
            f"status >= 400 AND NOT contains(path, '{TEST_PATH}') AND path <> '{NULL_RENAME}'"
            f" AND NOT (status = 400 AND contains(path, '{SIGNUP_PATH}'))"
        )
        .selectExpr(
            "source", "line_no", *keep,
            "CASE WHEN status >= 500 THEN 'critical' WHEN status >= 404 THEN 'error' ELSE 'warning' END AS severity",
            "concat('HTTP ', status, ': ', method, ' ', path) AS message", "'http' AS type",
        )
    )


def classify_log_lines(lines: DataFrame, profile: str = "server", keep: tuple[str, ...] = ()) -> DataFrame:
    """Errors and warnings among log lines by the rules of a profile; the first rule that matches decides."""
    rules = _PROFILES[profile]
    level = " ".join(f"WHEN {cond} THEN {sev or 'NULL'}" for cond, sev, _ in rules)
    kind = " ".join(f"WHEN {cond} THEN {quote(t) if t else 'NULL'}" for cond, _, t in rules)
    return (
        lines.selectExpr("source", "line_no", *keep, r"regexp_replace(line, r'^\s+|\s+$', '') AS line")
        .filter("line <> ''")
        .selectExpr("*", "lower(line) AS low")
        .selectExpr(
            "source", "line_no", *keep, f"CASE {level} END AS severity", f"substring(line, 1, {_CUT[profile]}) AS message",
            f"CASE {kind} END AS type",
        )
        .filter("severity IS NOT NULL")
    )


def tail_lines(lines: DataFrame, n: int) -> DataFrame:
    """The last ``n`` lines of each source."""
    return top_per_key(lines, ["source"], ["line_no DESC"], n).drop("rank")


_RANK = "CASE severity " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(SEVERITY)) + " ELSE 3 END"


def rank_errors(errors: DataFrame, n: int = 150) -> DataFrame:
    """The ``n`` most severe, with the total before the cut."""
    return (
        errors.sparkSession.sql("SELECT *, (SELECT count(*) FROM {e}) AS total FROM {e}", e=errors)
        .selectExpr("*", f"{_RANK} AS severity_rank")
        .orderBy("severity_rank", "source", "line_no")
        .limit(n)
    )


def error_summary(errors: DataFrame) -> DataFrame:
    """Count per severity and in total."""
    return errors.agg(
        F.count("*").alias("total"),
        *[F.expr(f"count_if(severity = '{s}')").alias(s) for s in ("critical", "error", "warning")],
    )


def dedupe_errors(errors: DataFrame, n: int = 20) -> DataFrame:
    """The first of each (source, first 50 characters), then the first ``n`` of those."""
    return (
        errors.groupBy("source", F.expr("substring(message, 1, 50)").alias("head"))
        .agg(F.expr("min(struct(line_no, severity, message))").alias("x"))
        .selectExpr("source", "x.line_no", "x.severity", "x.message")
        .orderBy("line_no", "source")
        .limit(n)
    )


def recent_samples(samples: DataFrame, kept: int = 60, shown: int = 30) -> DataFrame:
    """The last ``kept`` samples ``(metric, ts, sample_id, value)`` of each metric; ``shown`` marks the newest."""
    return top_per_key(samples, ["metric"], ["ts DESC", "sample_id DESC"], kept).withColumn("shown", F.expr(f"rank <= {shown}"))


def run_metrics(calls: DataFrame) -> DataFrame:
    """Calls, total and mean seconds of each run ``(run_id, seconds)``."""
    return calls.groupBy("run_id").agg(F.count("seconds").alias("calls"), F.expr("coalesce(sum(seconds), 0)").alias("s")).selectExpr(
        "run_id", "calls", "round(s, 2) AS total_sec", "round(s / greatest(1, calls), 2) AS avg_sec"
    )


def chapter_times(calls: DataFrame) -> DataFrame:
    return calls.groupBy("run_id", "chapter").agg(F.expr("round(sum(seconds), 2)").alias("seconds"))


# Token buckets. Tokens are counted in 1/60,000,000, so that a refill of r per minute adds r units per
# microsecond and everything is exact in integers.
TOKEN = 60_000_000
# Tokens at the start, refill per minute, most tokens held.
KEY_BUCKET = {"start": 60, "rate": 60, "cap": 70}
GLOBAL_BUCKET = {"start": 100, "rate": 30, "cap": 35}
REQUEST_COST = (
    "CASE WHEN contains(path, '/api/test-plan') OR contains(path, '/api/v2/test-plan') THEN 5"
    " WHEN contains(path, '/ws/') THEN 2 ELSE 1 END"
)
UNLIMITED = "startswith(path, '/static') OR path IN ('/health', '/api/health', '/')"


def request_costs(requests: DataFrame) -> DataFrame:
    """Requests ``(key, request_id, ts_us, path)`` that are limited at all, with their cost in tokens."""
    return requests.filter(f"NOT ({UNLIMITED})").selectExpr("*", f"{REQUEST_COST} AS cost")


def spend(tokens: int, gap_us: int, cost: int, rate: int, cap: int) -> tuple[int, bool]:
    """One request against a bucket: the tokens left and whether it was allowed."""
    tokens = min(cap, tokens + gap_us * rate)
    return (tokens - cost, True) if tokens >= cost else (tokens, False)


class Transfer:
    """Tokens after a segment as a function of the tokens before it: pieces ``slope * x + shift`` from ``low`` on.

    Refills and requests only shift, clamp and split pieces, so segments of one key can be summarised in
    parallel and chained afterwards.
    """

    def __init__(self, low: int):
        self.low, self.slope, self.shift = np.array([low]), np.array([1]), np.array([0])

    def _split(self, at: np.ndarray) -> None:
        high = np.append(self.low[1:], np.iinfo(np.int64).max)
        inside = (self.slope == 1) & (at > self.low) & (at < high)
        low = np.concatenate([self.low, at[inside]])
        order = np.argsort(low, kind="stable")
        self.low = low[order]
        self.slope = np.concatenate([self.slope, self.slope[inside]])[order]
        self.shift = np.concatenate([self.shift, self.shift[inside]])[order]

    def _merge(self) -> None:
        keep = np.ones(len(self.low), dtype=bool)
        keep[1:] = (self.slope[1:] != self.slope[:-1]) | (self.shift[1:] != self.shift[:-1])
        self.low, self.slope, self.shift = self.low[keep], self.slope[keep], self.shift[keep]

    def refill(self, units: int, cap: int) -> None:
        self.shift = self.shift + units
        self._split(cap - self.shift)
        full = np.where(self.slope == 1, self.low, 0) + self.shift >= cap
        self.slope, self.shift = np.where(full, 0, self.slope), np.where(full, cap, self.shift)
        self._merge()

    def request(self, cost: int) -> None:
        self._split(cost - self.shift)
        allowed = np.where(self.slope == 1, self.low, 0) + self.shift >= cost
        self.shift = np.where(allowed, self.shift - cost, self.shift)
        self._merge()


def rate_limit_replay(
    requests: DataFrame, bucket: dict = KEY_BUCKET, whole_rows: int = SEGMENT_ROWS, segment_us: int = 300_000_000
) -> DataFrame:
    """Which requests ``(key, request_id, ts_us, cost)`` a token bucket per key allows, and when to retry.

    A key with at most ``whole_rows`` requests is folded as it is. A busier key is cut into time segments:
    each is summarised as a function of the tokens it starts with, the functions are chained per key (one
    small row per segment), and then every segment is folded from its known start.
    """
    start, rate, cap = bucket["start"] * TOKEN, bucket["rate"], bucket["cap"] * TOKEN
    start = min(start, cap)
    low = min(0, start - segment_us * rate)

    counts = requests.groupBy("key").agg(F.count("*").alias("_n"), F.min("ts_us").alias("_first"))
    keyed = requests.select("key", "request_id", "ts_us", "cost").join(counts, "key").selectExpr(
        "*", f"CASE WHEN _n > {whole_rows} THEN CAST(floor(ts_us / {segment_us}) AS BIGINT) END AS seg"
    )

    def summarise(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts_us", "request_id"])
        f, now = Transfer(low), int(key[1]) * segment_us
        for ts, cost in zip(pdf["ts_us"].tolist(), pdf["cost"].tolist()):
            f.refill((ts - now) * rate, cap)
            f.request(int(cost) * TOKEN)
            now = ts
        f.refill(((int(key[1]) + 1) * segment_us - now) * rate, cap)
        return pd.DataFrame({
            "key": [key[0]], "seg": [key[1]], "first": [int(pdf["_first"].iloc[0])],
            "low": [f.low.tolist()], "slope": [f.slope.tolist()], "shift": [f.shift.tolist()],
        })

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seg")
        # The bucket is made full of its start tokens at the first request, not at the segment's begin.
        tokens, entries, prev = None, [], None
        for seg, first, lows, slope, shift in zip(pdf["seg"], pdf["first"], pdf["low"], pdf["slope"], pdf["shift"]):
            if tokens is None:
                tokens = start - (first - int(seg) * segment_us) * rate
            else:
                tokens = min(cap, tokens + (int(seg) - prev - 1) * segment_us * rate)
            entries.append(tokens)
            i = int(np.searchsorted(np.asarray(lows), tokens, side="right")) - 1
            tokens = int(slope[i]) * tokens + int(shift[i])
            prev = int(seg)
        return pd.DataFrame({"key": pdf["key"], "seg": pdf["seg"], "entry": entries})

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts_us", "request_id"])
        entry = pdf["entry"].iloc[0]
        if pd.isna(entry):
            tokens, now = start, int(pdf["ts_us"].iloc[0])
        else:
            tokens, now = int(entry), int(pdf["seg"].iloc[0]) * segment_us
        allowed, wait = [], []
        for ts, cost in zip(pdf["ts_us"].tolist(), pdf["cost"].tolist()):
            need = int(cost) * TOKEN
            tokens, ok = spend(tokens, ts - now, need, rate, cap)
            now = ts
            allowed.append(ok)
            wait.append(0 if ok else need - tokens)
        return pd.DataFrame({
            "key": pdf["key"], "request_id": pdf["request_id"], "allowed": allowed,
            "retry_after": np.asarray(wait, dtype="float64") / (rate * 1_000_000),
        })

    key_type = requests.schema["key"].dataType.simpleString()
    id_type = requests.schema["request_id"].dataType.simpleString()
    pieces = keyed.filter("seg IS NOT NULL").groupBy("key", "seg").applyInPandas(
        summarise, f"key {key_type}, seg long, first long, low array<long>, slope array<long>, shift array<long>"
    )
    entries = pieces.groupBy("key").applyInPandas(chain, f"key {key_type}, seg long, entry long")
    entries = entries.selectExpr("key AS _key", "seg AS _seg", "entry")
    return (
        keyed.join(entries, F.expr("key = _key AND seg <=> _seg"), "left")
        .select("key", "seg", "request_id", "ts_us", "cost", F.col("entry").cast("long"))
        .groupBy("key", "seg")
        .applyInPandas(fold, f"key {key_type}, request_id {id_type}, allowed boolean, retry_after double")
    )
