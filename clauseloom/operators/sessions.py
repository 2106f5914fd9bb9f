"""Chat sessions, users and messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.functions.text import quote
from clauseloom.plans.stage import stage


def list_sessions(sessions: DataFrame, user_id: str | None = None) -> DataFrame:
    """Sessions of a user (or of all), newest update first."""
    own = sessions if user_id is None else sessions.filter(F.col("user_id") == user_id)
    return own.orderBy(F.desc("updated_at"), "session_id")


def search_sessions(sessions: DataFrame, messages: DataFrame, q: str) -> DataFrame:
    """Sessions whose title or any message holds ``q``, whatever the case; an empty ``q`` finds all."""
    if not q:
        return sessions
    low = quote(q.lower())
    said = messages.filter(f"contains(lower(content), {low})").select("session_id").distinct().withColumn("_said", F.lit(True))
    return (
        sessions.join(said, "session_id", "left")
        .filter(f"_said OR contains(lower(coalesce(title, '')), {low})")
        .drop("_said")
    )


#: Characters of the pieces by which texts are found.
GRAM = 3


def _grams(text: str, size: str) -> str:
    """The distinct pieces of ``size`` characters of a text; none if it is shorter."""
    return (
        f"CASE WHEN length({text}) >= {size} THEN array_distinct(transform(sequence(1, length({text}) - {size} + 1), "
        f"i -> substring({text}, i, {size}))) ELSE CAST(array() AS ARRAY<STRING>) END"
    )


def search_sessions_many(sessions: DataFrame, messages: DataFrame, searches: DataFrame) -> DataFrame:
    """:func:`search_sessions` for any number of ``searches(search_id, q)`` in one read of titles and messages.

    Texts are posted under their pieces of ``GRAM`` characters, as far as some search asks for them, and a search looks only at the texts
    under its rarest piece, which are then compared with the whole of it. A search of fewer characters is one piece of its own length.
    """
    asked = stage(searches.selectExpr("search_id", "lower(coalesce(q, '')) AS q").distinct().selectExpr("*", f"least({GRAM}, length(q)) AS size"), "searches")
    pieces = asked.filter("size > 0").selectExpr("search_id", "q", f"explode({_grams('q', 'size')}) AS gram")
    wanted = stage(pieces.select("gram").distinct(), "wanted-grams")
    # At most GRAM rows.
    sizes = [r["size"] for r in asked.filter("size > 0").select("size").distinct().collect()]
    texts = sessions.selectExpr("session_id", "-1L AS turn", "lower(coalesce(title, '')) AS low").unionByName(
        messages.selectExpr("session_id", "CAST(turn AS BIGINT) AS turn", "lower(content) AS low"))
    found = asked.filter("size = 0").select("search_id").join(sessions.select("session_id"))
    if sizes:
        every = ", ".join(_grams("low", str(n)) for n in sizes)
        posted = texts.selectExpr("session_id", "turn", f"explode(flatten(array({every}))) AS gram").join(wanted, "gram", "left_semi")
        posted = stage(posted.select("gram", "session_id", "turn"), "postings")
        counts = wanted.join(posted.groupBy("gram").agg(F.count("*").alias("n")), "gram", "left").selectExpr("gram", "coalesce(n, 0) AS n")
        rarest = pieces.join(counts, "gram").groupBy("search_id", "q").agg(F.expr("min_by(gram, struct(n, gram))").alias("gram"))
        likely = rarest.join(posted, "gram").select("search_id", "q", "session_id", "turn")
        held = likely.join(texts, ["session_id", "turn"]).filter("contains(low, q)").select("search_id", "session_id").distinct()
        found = found.unionByName(held)
    return found.join(sessions, "session_id")


def update_sessions(sessions: DataFrame, changes: DataFrame) -> DataFrame:
    """Sessions after change rows ``(session_id, seq, action, title, ts)``: ``star`` toggles, ``rename`` sets
    the title and the update time, ``delete`` removes."""
    net = changes.groupBy("session_id").agg(
        F.expr("count_if(action = 'star') % 2 = 1").alias("_flip"),
        F.expr("max_by(title, seq) FILTER (WHERE action = 'rename')").alias("_title"),
        F.expr("max_by(ts, seq) FILTER (WHERE action = 'rename')").alias("_ts"),
        F.expr("count_if(action = 'delete') > 0").alias("_gone"),
    )
    new = {
        "starred": "CASE WHEN _flip THEN NOT coalesce(starred, false) ELSE coalesce(starred, false) END AS starred",
        "title": "coalesce(_title, title) AS title",
        "updated_at": "coalesce(_ts, updated_at) AS updated_at",
    }
    return sessions.join(net, "session_id", "left").filter("NOT coalesce(_gone, false)").selectExpr(
        *[new.get(c, c) for c in sessions.columns]
    )


def session_titles(messages: DataFrame) -> DataFrame:
    """The first 50 characters of the first user message."""
    return messages.filter("role = 'user'").groupBy("session_id").agg(
        F.expr("substring(min_by(content, turn), 1, 50)").alias("title")
    )


def list_users(users: DataFrame, n: int = 50) -> DataFrame:
    """The newest ``n`` users and the number of all."""
    return (
        users.sparkSession.sql("SELECT *, (SELECT count(*) FROM {u}) AS total_users FROM {u}", u=users)
        .orderBy(F.desc_nulls_last("created_at"), "user_id")
        .limit(n)
    )


def username_conflicts(signups: DataFrame, users: DataFrame) -> DataFrame:
    """Sign-ups ``(signup_id, username)`` whose name is taken by a user or by an earlier sign-up."""
    first = signups.groupBy("username").agg(F.min("signup_id").alias("_first"))
    taken = users.select("username").distinct().withColumn("_taken", F.lit(True))
    verdict = first.join(taken, "username", "left")
    return signups.join(verdict, "username").filter("_taken OR signup_id <> _first").select(*signups.columns)


def generated_file_lookup(sessions: DataFrame, asked: DataFrame) -> DataFrame:
    """File of each asked ``message_id`` through the file map of the sessions; the smallest session wins."""
    files = sessions.selectExpr("session_id", "explode(test_plan_files) AS (message_id, file_path)")
    one = files.groupBy("message_id").agg(F.expr("min_by(file_path, session_id)").alias("file_path"), F.min("session_id").alias("session_id"))
    return asked.select("message_id").distinct().join(one, "message_id", "left")


# Fixed value: longest message taken.
MAX_MESSAGE_LENGTH = 4000


def message_rules(messages: DataFrame, limit: int = MAX_MESSAGE_LENGTH) -> DataFrame:
    """``verdict``: ``empty`` (dropped), ``too_long`` (rejected, with the error) or ``ok``."""
    # Fixed value: the message.
    return messages.selectExpr(
        "*",
        f"CASE WHEN coalesce(content, '') = '' THEN 'empty' WHEN length(content) > {limit} THEN 'too_long' ELSE 'ok' END AS verdict",
        f"CASE WHEN length(content) > {limit} THEN 'Message too long. Maximum {limit} characters allowed.' END AS error",
    )
