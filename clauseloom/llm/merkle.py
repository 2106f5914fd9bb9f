"""A Merkle manifest of a dataset: one tree of hashes per group, a tree over their roots, and a proof for every row.

A leaf is the hash of a row's named fields, each with its length, so that no two rows give the same bytes. Leaves stand in the order
of their key; two neighbours become one node, level by level, a node left over is hashed alone. The roots of the groups are the leaves
of one more tree.

*Store.* ``BITS`` levels are built at a time inside a block of 2**BITS neighbours, which is all that ever meets in one group. What is
stored is a row per node that begins such a hop, with the siblings up to the hop's end (:func:`build`) and a link to its parent, the node
that begins the next hop. Above the first hop a row is stored once per block of leaves below it (:func:`links`), so that
no row is joined with more than 2**BITS leaves, however large a group is.

*Climb.* A recursive query starts from the leaves, follows the links hop by hop, appends the siblings of each hop and folds the leaf's hash,
tampered with or not, with them (:func:`climb`). It takes one round per hop: four at 10**12 leaves.

Edge cases: a null field is ``-``; a null group is a group that comes first, a null key comes first in its group; rows that share a key
stand in the order of their leaves. A group of one leaf has that leaf as its root, one group alone has its root as that of the dataset.
Texts are hashed whole. An empty table gives an empty result. Extra columns are not read. Numbers must be integers: they are written in decimals.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.plans.ordered import rank_all
from clauseloom.plans.stage import discard, stage

#: Levels per hop; a block holds two to the power of it.
BITS = 10

#: Rows of the store that are sent to every executor at most, instead of being shuffled.
BROADCAST_ROWS = 65_536

_FOREST = -1
_PATH = "array<struct<left: boolean, h: binary>>"


def _sized(value: Column) -> Column:
    told = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(told).cast("string"), F.lit(":"), told), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(_sized, values)), 256))


def leaves(df: DataFrame, key: str, group: str, fields: list[str], tampered: dict[str, Column], where: Column) -> DataFrame:
    """k, g, leaf and what the leaf is after ``tampered`` columns replace those of the rows chosen by ``where``; null for others."""
    altered = leaf([tampered.get(f, F.col(f)) for f in fields])
    return df.select(
        F.col(key).alias("k"), F.col(group).cast("string").alias("g"), leaf([F.col(f) for f in fields]).alias("leaf"),
        F.when(F.coalesce(where, F.lit(False)), altered).alias("altered"),
    )


def _levels(bits: int) -> list[str]:
    """SQL of the arrays l0, l1, ... of a block's nodes; level i + 1 is made from level i."""
    node = "unhex(sha2(concat(lower(hex(l{0}[2 * i])), coalesce(lower(hex(get(l{0}, 2 * i + 1))), '')), 256))"
    return [f"transform(sequence(0, (size(l{i}) - 1) DIV 2), i -> {node.format(i)})" for i in range(bits)]


def build(nodes: DataFrame, bits: int = BITS) -> tuple[list[DataFrame], DataFrame]:
    """Hops of trees from their leaves (tree, n leaves of the tree, pos, h, and ``row``, which goes along with a leaf).

    Returns per floor the rows (tree, pos, n, h, path, top, row), written to the shared folder, and the roots (tree, h). ``n``
    counts the tree's nodes on that floor; on its last floor a path ends at the root and ``top`` holds.
    """
    span, floors, roots = 1 << bits, [], []
    while True:
        blocks = nodes.withColumn("seat", F.expr(f"pos DIV {span}")).groupBy("tree", "seat").agg(
            F.max("n").alias("n"), F.expr("array_sort(collect_list(struct(pos, h, row)))").alias("rows")
        ).withColumn("l0", F.expr("transform(rows, r -> r.h)"))
        for i, level in enumerate(_levels(bits)):
            # A tree whose nodes all fit into one block ends where one is left; others fill the hop.
            done = f"size(l{i}) = 0 OR (n <= {span} AND size(l{i}) = 1)"
            blocks = blocks.withColumn(f"l{i + 1}", F.expr(f"CASE WHEN {done} THEN CAST(array() AS ARRAY<BINARY>) ELSE {level} END"))
        steps = ", ".join(
            f"CASE WHEN size(l{i + 1}) > 0 THEN struct(shiftright(i, {i}) % 2 = 1 AS left, CASE WHEN shiftright(i, {i}) % 2 = 1 "
            f"THEN l{i}[shiftright(i, {i}) - 1] ELSE get(l{i}, shiftright(i, {i}) + 1) END AS h) END"
            for i in range(bits)
        )
        last = f"coalesce({', '.join(f'CASE WHEN size(l{i}) > 0 THEN l{i}[0] END' for i in reversed(range(bits + 1)))})"
        path = f"CAST(filter(array({steps}), s -> s IS NOT NULL) AS {_PATH})"
        each = f"posexplode(transform(rows, (r, i) -> struct(r.pos AS pos, r.h AS h, r.row AS row, {path} AS path))) AS (i, r)"
        whole = blocks.selectExpr("tree", "seat", "n", f"n <= {span} AS top", f"{last} AS up", each)
        # The first row of a block carries what the block becomes.
        floor = stage(whole.selectExpr("tree", "seat", "r.*", "n", "top", "CASE WHEN i = 0 THEN up END AS up"), "merkle-floor")
        floors.append(floor)
        ends = floor.filter("up IS NOT NULL")
        roots.append(ends.filter("top").selectExpr("tree", "up AS h"))
        more = ends.filter("NOT top")
        if more.isEmpty():
            break
        nodes = more.selectExpr("tree", f"(n + {span - 1}) DIV {span} AS n", "seat AS pos", "up AS h", "CAST(NULL AS STRUCT<x: INT>) AS row")
    out = roots[0]
    for r in roots[1:]:
        out = out.unionByName(r)
    return floors, out


def _small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if it is small enough, which a count of at most one row more tells."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def links(floors: list[DataFrame], forest: list[DataFrame], places: DataFrame, bits: int = BITS) -> DataFrame:
    """The store that is climbed: what follows the hop of a block of leaves (tree, seat), hop by hop.

    One row per (tree, seat, step): ``path``, the ``subroot`` if the hop begins at one, and ``up``, the step of the parent, null at the root.
    ``places`` (tree, place, hops) tells where a tree's root stands in the forest and how many hops the tree has.
    """
    span = 1 << bits
    seats = floors[0].select("tree", "seat").distinct()
    rows = []
    for f, floor in enumerate(floors[1:], 1):
        node = floor.selectExpr("tree AS t", "pos AS p", "path")
        down = span ** (f - 1)
        met = seats.join(_small(node), F.expr(f"tree = t AND seat DIV {down} = p"))
        rows.append(met.selectExpr("tree", "seat", f"{f} AS step", "path", "CAST(NULL AS BINARY) AS subroot", f"{f + 1} AS up"))
    # The hops of the forest come after as many as the tree has.
    placed = seats.join(_small(places.selectExpr("tree AS t", "place", "hops")), F.expr("tree = t")).drop("t")
    for f, floor in enumerate(forest):
        node = floor.selectExpr("pos AS p", "path", f"{'h' if f == 0 else 'CAST(NULL AS BINARY)'} AS subroot", "top")
        met = placed.join(_small(node), F.expr(f"place DIV {span ** f} = p"))
        rows.append(met.selectExpr("tree", "seat", f"hops + {f} AS step", "path", "subroot", f"CASE WHEN NOT top THEN hops + {f + 1} END AS up"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@contextmanager
def _any_rows(spark: SparkSession) -> Iterator[None]:
    """Recursive queries may return any number of rows; by default Spark stops them at a million."""
    name = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: A hash folded with the siblings of a path, and these siblings in a row.
_FOLD = (
    "unhex(aggregate({path}, lower(hex({of})), (a, s) -> sha2(concat(CASE WHEN s.left THEN lower(hex(s.h)) ELSE '' END, a, "
    "CASE WHEN s.left THEN '' ELSE coalesce(lower(hex(s.h)), '') END), 256)))"
)
_SIBLINGS = "aggregate({path}, CAST('' AS BINARY), (a, s) -> concat(a, coalesce(s.h, CAST('' AS BINARY))))"

_CLIMB = f"""
WITH RECURSIVE climb(k, leaf, tree, seat, up, folded, proof, subroot) AS (
  SELECT row.k, h, tree, seat, 1, {_FOLD.format(path='path', of='coalesce(row.altered, h)')}, {_SIBLINGS.format(path='path')}, CAST(NULL AS BINARY)
  FROM {{start}}
  UNION ALL
  SELECT c.k, c.leaf, c.tree, c.seat, l.up, {_FOLD.format(path='l.path', of='c.folded')}, concat(c.proof, {_SIBLINGS.format(path='l.path')}),
    coalesce(c.subroot, l.subroot)
  FROM climb c JOIN {{links}} l ON c.tree = l.tree AND c.seat = l.seat AND c.up = l.step)
SELECT k, leaf, subroot, proof, folded FROM climb WHERE up IS NULL
"""


def climb(start: DataFrame, store: DataFrame) -> DataFrame:
    """k, leaf, subroot, proof and folded root of every row of the first floor, by a recursive query over the linked store."""
    spark = start.sparkSession
    with _any_rows(spark):
        return stage(spark.sql(_CLIMB, start=start, links=store), "merkle-climb")


def manifest(
    df: DataFrame, key: str, group: str, fields: list[str], tampered: dict[str, Column], where: Column, bits: int = BITS
) -> DataFrame:
    """k, leaf, subroot, root, proof_sha256, folded_root and verified of every row; all but the last two are those of the untampered rows."""
    hashed = stage(leaves(df, key, group, fields, tampered, where), "merkle-leaves")
    groups = hashed.groupBy("g").agg(F.count(F.lit(1)).alias("n")).withColumn("all", F.lit(0))
    trees = stage(rank_all(groups, ["all"], ["g"], "tree").selectExpr("g AS tree_g", "n", "tree - 1 AS tree"), "merkle-trees")
    # (g, k, leaf) need not be unique: rows equal in all three are interchangeable.
    placed = rank_all(hashed, ["g"], ["k", "leaf"], "pos").join(trees, F.expr("g <=> tree_g"))
    nodes = placed.selectExpr("tree", "n", "pos - 1 AS pos", "leaf AS h", "struct(k, altered) AS row")
    floors, subroots = build(nodes, bits)
    tops = trees.join(subroots, "tree").selectExpr(
        f"{_FOREST}L AS tree", "count(*) OVER () AS n", "tree AS pos", "h", "CAST(NULL AS STRUCT<x: INT>) AS row"
    ) if floors else subroots
    forest, roots = build(tops, bits)
    hops = F.expr("1" + "".join(f" + CAST(n > {1 << (bits * f)}L AS INT)" for f in range(1, len(floors) + 1)))
    store = stage(links(floors, forest, trees.select("tree", F.col("tree").alias("place"), hops.alias("hops")), bits), "merkle-links")
    climbed = climb(floors[0].filter("row IS NOT NULL"), store)
    # The root of the dataset is one row; an empty dataset has none.
    root = next((r["h"] for r in roots.collect()), None)
    discard(hashed, trees, *floors, *forest, store)
    told = F.lower(F.hex(F.lit(bytes(root) if root is not None else b"")))
    return climbed.select(
        "k", F.lower(F.hex("leaf")).alias("leaf"), F.lower(F.hex("subroot")).alias("subroot"), told.alias("root"),
        F.sha2(F.lower(F.hex("proof")), 256).alias("proof_sha256"), F.lower(F.hex("folded")).alias("folded_root"),
        (F.lower(F.hex("folded")) == told).alias("verified"),
    )
