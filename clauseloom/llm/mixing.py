"""Hierarchical budgeting: a token budget down a tree of domain, language and source, by DataFrame operations only.

Every node asks for its share of its parent's budget by weight. What a node cannot fill, even with all its epochs,
goes to its siblings in proportion to their weights; only what the whole family cannot use goes up to the siblings
of the parent. Since a node's capacity is the sum of its leaves' capacities, filling the tree from the root with
capped shares does exactly that: at each level the share per weight is the water level at which the children's
capped shares add up to the parent's budget.

A leaf then takes whole epochs and, from the next one, the longest prefix that fits, in an order that a seeded hash
of the epoch and the key gives. Prefix sums are taken over ranges of that hash, first coarse and then fine inside
the one range that the cut falls in, so no window ever holds a leaf's rows, however many it has.

Edge cases: null levels are the empty name; a null or empty text has no tokens; a leaf without tokens has no
capacity and its rows are taken (no copy of them costs anything) only if their prefix comes first. Repeated keys
count as rows of their own and part by a hash of their place. Weights that are not named count 1, and must not be
negative; a weight of 0 takes nothing. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.llm.common import HASH_BITS, hash60, numbered
from clauseloom.plans.stage import stage

#: Bits of the hash order that one round of prefix sums tells apart.
ROUND_BITS = 12

#: A range with no more rows than this is summed row by row.
RANGE_ROWS = 4096

#: Added before a share is cut to whole tokens, against the last digit of floating point.
NUDGE = 1e-6


def _weight(level: str, weights: dict[str, float]) -> Column:
    out = F.lit(1.0)
    for name, weight in weights.items():
        out = F.when(F.col(level) == name, F.lit(float(weight))).otherwise(out)
    return out


def budgets(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, float]], budget: Column) -> DataFrame:
    """``leaves`` (levels, tokens, capacity) with ``budget``: the tokens that each leaf is to give.

    One row per leaf; the windows hold the children of one node.
    """
    tree = leaves.withColumn("parent_budget", budget)
    for i, level in enumerate(levels):
        path, up = levels[: i + 1], levels[:i]
        nodes = tree.groupBy(*path).agg(F.sum("capacity").alias("cap"), F.first("parent_budget").alias("whole"))
        nodes = nodes.withColumn("w", _weight(level, weights.get(level, {}))).withColumn(
            "full_at", F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(F.lit(float("inf")))
        )
        order = Window.partitionBy(*up).orderBy("full_at", level)
        below = order.rowsBetween(Window.unboundedPreceding, -1)
        above = order.rowsBetween(0, Window.unboundedFollowing)
        nodes = nodes.withColumn("taken", F.coalesce(F.sum("cap").over(below), F.lit(0))).withColumn(
            "w_left", F.sum("w").over(above)
        )
        # Once a child is not full, neither is any later one, and all of those share what is left by weight.
        share = (F.col("whole") - F.col("taken")) / F.col("w_left")
        nodes = nodes.withColumn("level_here", F.when(F.col("w_left") > 0, share).otherwise(F.lit(0.0)))
        nodes = nodes.withColumn(
            "level", F.min(F.when(F.col("full_at") > F.col("level_here"), F.struct("full_at", level, "level_here")))
            .over(Window.partitionBy(*up))["level_here"],
        )
        fits = F.col("level").isNull() | (F.col("full_at") <= F.col("level"))
        given = F.when(F.col("w") <= 0, F.lit(0)).when(fits, F.col("cap")).otherwise(
            F.floor(F.col("w") * F.col("level") + NUDGE)
        )
        nodes = nodes.select(*path, F.least(F.col("cap"), given).cast("long").alias("parent_budget"))
        tree = tree.drop("parent_budget").join(nodes, path)
    return tree.withColumnRenamed("parent_budget", "budget")


def _partial(rows: DataFrame, levels: list[str]) -> DataFrame:
    """Which rows lie in the prefix of the next epoch: ``place`` of the rows taken.

    ``rows``: levels, place, h, h2, n_tokens and the leaf's ``rest``.
    """
    taken = []
    depth = 0
    while True:
        side, used = ("h", depth) if depth < HASH_BITS else ("h2", depth - HASH_BITS)
        slot = F.shiftright(side, HASH_BITS - ROUND_BITS - used).bitwiseAND((1 << ROUND_BITS) - 1)
        at = rows.withColumn("slot", slot)
        sums = at.groupBy(*levels, "slot").agg(
            F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n"), F.first("rest").alias("rest")
        )
        order = Window.partitionBy(*levels).orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
        sums = stage(sums.withColumn("upto", F.sum("t").over(order)), "mixing-sums")
        whole = sums.filter("upto <= rest").select(*levels, "slot")
        # The one range of each leaf that begins inside the budget and ends beyond it.
        edge = sums.filter("upto > rest AND upto - t <= rest").select(
            *levels, "slot", "n", (F.col("rest") - (F.col("upto") - F.col("t"))).alias("left")
        )
        edge = edge.groupBy(*levels).agg(F.min(F.struct("slot", "n", "left")).alias("e")).select(*levels, "e.*")
        taken.append(at.join(whole, [*levels, "slot"], "left_semi").select("place"))
        rows = at.join(edge, [*levels, "slot"]).drop("rest").withColumnRenamed("left", "rest")
        most = edge.agg(F.max("n")).first()[0] or 0
        depth += ROUND_BITS
        if most <= RANGE_ROWS or depth >= 2 * HASH_BITS:
            break
        rows = stage(rows.drop("slot", "n"), "mixing-edge")
    order = Window.partitionBy(*levels).orderBy("h", "h2").rowsBetween(Window.unboundedPreceding, 0)
    taken.append(rows.withColumn("upto", F.sum("n_tokens").over(order)).filter("upto <= rest").select("place"))
    out = taken[0]
    for part in taken[1:]:
        out = out.unionByName(part)
    return out


def mix(
    df: DataFrame, key: str, tokens: Column, levels: list[str], weights: dict[str, dict[str, float]],
    share: float = 1.0, max_epochs: int = 4, seed: int = 0, carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of ``df``: key, the levels, n_tokens, leaf_tokens, leaf_budget, copies and the columns ``carry``.

    The budget is ``share`` of all tokens, as far as ``max_epochs`` epochs of every leaf can fill it. ``copies`` says
    in how many epochs the row is taken; 0 means not at all. Other columns of ``df`` are not read.
    """
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in levels]
    carried = [F.col(c).alias(f"_carry_{c}") for c in carry]
    rows = numbered(
        df.select(F.col(key).alias("k"), *carried, *named, F.coalesce(tokens.cast("long"), F.lit(0).cast("long")).alias("n_tokens")),
        "mixing",
    )
    leaves = rows.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens"))
    leaves = stage(leaves.withColumn("capacity", F.col("tokens") * max_epochs), "mixing-leaves")
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    plan = stage(budgets(leaves, levels, weights, F.lit(int(total * share))), "mixing-budgets")
    plan = plan.select(
        *levels, F.col("tokens").alias("leaf_tokens"), F.col("budget").alias("leaf_budget"),
        F.expr("CASE WHEN tokens > 0 THEN budget DIV tokens ELSE 0 END").cast("int").alias("epochs"),
        F.expr("CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END").alias("rest"),
    )
    seeded = hash60(F.concat_ws("/", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(F.col("k").cast("string"), F.lit(""))))
    rows = stage(rows.join(plan, levels).withColumn("h", seeded), "mixing-rows")
    partial = _partial(rows.select(*levels, "place", "h", "h2", "n_tokens", "rest"), levels)
    one = partial.withColumn("one", F.lit(1))
    return rows.join(one, "place", "left").select(
        F.col("k").alias(key), *levels, "n_tokens", "leaf_tokens", "leaf_budget",
        (F.col("epochs") + F.coalesce("one", F.lit(0))).alias("copies"),
        *[F.col(f"_carry_{c}").alias(c) for c in carry],
    )
