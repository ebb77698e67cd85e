"""Merkle manifest of a data set: one tree per group of rows, and a tree over the groups' roots.

A row's leaf is the SHA-256 of its columns, each written as ``-`` if null, else as its length in bytes, a
colon and the value. Nodes of a level are numbered. The level is joined with itself on computed sibling
indices: a run's node in slot zero asks for its own index plus 1, 2, ... (index XOR 1 in a binary tree),
takes the hashes found and emits the parent. A run may be short; even one node alone is hashed again, until
the level is that node only. Each level is a table, so a lost executor costs one level, and all work below the top is spread
over runs of ``arity`` nodes: no group's size matters. Proofs come down the same levels, one row per run;
only the row of a leaf, within its task, holds the whole path.

Nulls: a null group is a tree of its own and comes first among the roots; a null id sorts first in its tree.
Rows of one id are ordered by leaf, equal rows are several equal leaves with proofs of their own. Null and
empty texts give different leaves; texts are hashed whole, however long. An empty table has no leaves, no
root and an empty result. Only the named columns count: others are ignored, whatever they are called.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outings.llm.tables import written

ARITY = 16


class Forest(NamedTuple):
    """Trees by ``tree``: numbered leaves, the runs of each level and the trees' roots with their depth."""

    leaves: DataFrame
    levels: list[DataFrame]
    roots: DataFrame


def digest(columns: list[Column]) -> Column:
    """SHA-256 of the columns' values with their lengths, as lowercase hex."""
    values = [c.cast("string") for c in columns]
    fields = [
        F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values
    ]
    return F.sha2(F.concat(*fields), 256)


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds ``index``, the place within ``tree`` by id and leaf, and ``n``, the tree's rows.

    Rows are sorted across tasks. Each task and tree gives one total, and the totals before it are added.
    """
    order = ["tree", "id", "leaf"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = written(ordered.withColumn("at", F.monotonically_increasing_id()), "ordered")
    ordered = ordered.withColumn("part", F.shiftright("at", 33))
    parts = ordered.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("held"))
    whole = Window.partitionBy("tree")
    before = F.sum("held").over(whole.orderBy("part")) - F.col("held")
    base = parts.select(
        "tree", "part", (before - F.col("first")).alias("shift"), F.sum("held").over(whole).alias("n")
    )
    placed = ordered.join(base, ["tree", "part"])
    return placed.withColumn("index", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _runs(nodes: DataFrame, arity: int) -> DataFrame:
    """``tree``, ``run``, ``n`` and the run's ``hashes`` in order, of nodes ``tree``, ``index``, ``n``, ``hash``."""
    end = F.least(F.col("index") + arity, F.col("n"))
    offsets = F.when(end > F.col("index") + 1, F.sequence(F.lit(1).cast("long"), end - F.col("index") - 1))
    asking = nodes.filter(F.col("index") % arity == 0).select(
        "tree", F.expr(f"index div {arity}").alias("run"), "n", F.col("hash").alias("own"),
        F.col("index").alias("head"), F.explode_outer(offsets).alias("offset"),
    )
    asking = asking.withColumn("sibling", F.col("head") + F.col("offset"))
    siblings = nodes.select("tree", F.col("index").alias("sibling"), F.col("hash").alias("found"))
    met = asking.join(siblings, ["tree", "sibling"], "left")
    others = F.sort_array(F.collect_list(F.when(F.col("offset").isNotNull(), F.struct("offset", "found"))))
    runs = met.groupBy("tree", "run", "n", "own").agg(others.alias("others"))
    hashes = F.concat(F.array("own"), F.transform("others", lambda o: o["found"]))
    return runs.select("tree", "run", "n", hashes.alias("hashes"))


def grow(rows: DataFrame, arity: int = ARITY) -> Forest:
    """The trees over ``rows``: ``tree``, ``id``, ``leaf`` (other columns stay with the leaves)."""
    leaves = written(_numbered(rows), "leaves")
    nodes = leaves.select("tree", "index", "n", F.col("leaf").alias("hash"))
    most = leaves.agg(F.max("n").alias("n")).first().n or 0
    alone = lambda level, depth: level.filter("n = 1").select("tree", F.lit(depth).alias("depth"), "hash")
    roots, levels = alone(nodes, 0), []
    while most > 1:
        levels.append(written(_runs(nodes.filter("n > 1"), arity), "runs"))
        nodes = levels[-1].select(
            "tree", F.col("run").alias("index"), F.expr(f"(n + {arity - 1}) div {arity}").alias("n"),
            F.sha2(F.array_join("hashes", ""), 256).alias("hash"),
        )
        roots = roots.unionAll(alone(nodes, len(levels)))
        most = -(-most // arity)
    return Forest(leaves, levels, roots)


def _step(slot: Column) -> Column:
    """What stands before and after a slot in its run's hash."""
    before = F.array_join(F.slice("hashes", F.lit(1), slot), "")
    after = F.array_join(F.slice("hashes", slot + 2, F.size("hashes")), "")
    return F.array(F.struct(before.alias("before"), after.alias("after")))


NO_STEPS = "CAST(array() AS array<struct<before: string, after: string>>)"


def paths(forest: Forest, above: DataFrame, arity: int = ARITY) -> DataFrame:
    """The leaves with ``steps``, from the leaf upwards, and the columns of ``above``.

    ``above`` has per ``tree`` the ``steps`` beyond its root, and columns to hand down.
    """
    handed = [c for c in above.columns if c not in ("tree", "steps")]
    tops = above.join(forest.roots.select("tree", "depth"), "tree")
    at_depth = lambda d: tops.filter(F.col("depth") == d).select(
        "tree", F.lit(0).cast("long").alias("run"), "steps", *handed
    )
    nodes = at_depth(len(forest.levels))
    for depth in range(len(forest.levels) - 1, 0, -1):
        opened = forest.levels[depth].join(nodes, ["tree", "run"])
        members = opened.select("*", F.posexplode("hashes").alias("slot", "hash"))
        nodes = members.select(
            "tree", (F.col("run") * arity + F.col("slot")).alias("run"),
            F.concat(_step(F.col("slot")), "steps").alias("steps"), *handed,
        ).unionAll(at_depth(depth))
    lone = forest.leaves.filter("n = 1").join(at_depth(0).drop("run"), "tree")
    if not forest.levels:
        return lone
    opened = forest.levels[0].drop("n").join(nodes, ["tree", "run"])
    leaves = forest.leaves.filter("n > 1").withColumn("run", F.expr(f"index div {arity}"))
    slot = (F.col("index") % arity).cast("int")
    met = leaves.join(opened, ["tree", "run"]).withColumn("steps", F.concat(_step(slot), "steps"))
    return met.select(lone.columns).unionAll(lone)


def fold(steps: Column, leaf: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(steps, leaf, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def manifest(
    docs: DataFrame,
    columns: list[str],
    group: str,
    id: str,
    shown: dict[str, Column] | None = None,
    arity: int = ARITY,
) -> DataFrame:
    """Per row: ``id``, ``leaf``, ``subroot`` (its group's root), ``root``, ``steps``, ``folded_root``, ``verified``.

    ``shown`` replaces columns by what a reader finds later; the root is folded from that row's leaf and
    the stored siblings, and is verified if it is the stored root.
    """
    later = [(shown or {}).get(c, F.col(c)) for c in columns]
    rows = docs.select(
        F.col(id).alias("id"), F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("tree"),
        digest([F.col(c) for c in columns]).alias("leaf"), digest(later).alias("seen"),
    )
    rows = grow(written(rows, "digests"), arity)
    top = grow(rows.roots.select(F.lit("").alias("tree"), F.col("tree").alias("id"), F.col("hash").alias("leaf")), arity)
    crown = top.roots.select("tree", F.col("hash").alias("root"), F.expr(NO_STEPS).alias("steps"))
    groups = paths(top, crown, arity).select(F.col("id").alias("tree"), F.col("leaf").alias("subroot"), "root", "steps")
    proven = paths(rows, written(groups, "groups"), arity)
    return proven.withColumn("folded_root", fold(F.col("steps"), F.col("seen"))).select(
        "id", "leaf", "subroot", "root", "steps", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


def proof_digest(steps: Column) -> Column:
    """SHA-256 of a proof's siblings, from the leaf's run to the root's, left to right in each run."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), ""), 256)
