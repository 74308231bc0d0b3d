"""A Merkle manifest of a dataset, and proofs of its rows by coordinate lookup.

Every row is a leaf: the digest of its fields, written with their lengths. The rows of a group are numbered by their order
column over range partitions; while a group has several nodes, each run of consecutive ones becomes the digest of the
run. What is left is the group's subroot, and the subroots, in the order of the groups, make the root in the same way. All
nodes are rows of one table, (tree, level, index, digest).

Where the nodes of a proof lie follows from a leaf's index and the size of its group alone. So a leaf explodes the
coordinates of the siblings that it needs and joins the node table on them; what is found is put in order, concatenated and
folded. A group's own path to the root is looked up once for the group. No key of these joins is hot: levels whose nodes fit a
broadcast (their number has been counted) are broadcast, and a node of a level below those is wanted by the few leaves under
its run only. Each level is written once; a text is read once and never shuffled.

Defined results: a null field is a sign of its own and differs from an empty one; very long texts are hashed whole; rows
that tie in group and order come by their leaf digests, and repeated rows are leaves of their own; a null group or order
value comes first; an empty table has no leaves, no proofs and the root null; columns that are no fields are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import BROADCAST_BYTES, broadcast_if_small, materialize, numbered

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree whose leaves are the subroots; those of the groups are numbered from 0.
TOP = -1
#: About what a node takes in a broadcast.
NODE_BYTES = 100
#: More levels than any tree of 64-bit indexes has at the least fanout.
LEVELS = 64


def digest(text: Column) -> Column:
    """The sha256 of a text, as bytes."""
    return F.unhex(F.sha2(text, 256))


def written(column: Column) -> Column:
    """A field as it enters a leaf: its length in bytes and itself, or the sign for null."""
    text = column.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(fields: list[Column]) -> Column:
    return digest(F.concat(*map(written, fields)))


def _hex(column: Column) -> Column:
    return F.lower(F.hex(column))


def joined(digests: Column) -> Column:
    """The digests of an array as hex text, one after the other."""
    return F.array_join(F.transform(digests, _hex), "")


@dataclass(frozen=True)
class Manifest:
    """leaves: tree, index, leaf and kept columns; nodes: tree, level, index, digest; trees: tree, group, n (its leaves), subroot.

    All are tables in the shared folder; root is null where there are no leaves.
    """

    leaves: DataFrame
    nodes: DataFrame
    trees: DataFrame
    root: bytes | None
    group: str
    fanout: int


def _spans(fanout: int) -> Column:
    """How many leaves lie under a node, by level."""
    return F.array(*(F.lit(fanout**k).cast("long") for k in range(LEVELS) if fanout**k < 2**63))


def _over(index: Column, span: Column) -> Column:
    return F.call_function("div", index, span)


def _height(n: Column, fanout: int) -> Column:
    """How often a tree of n leaves is shortened until one node is left."""
    return F.size(F.filter(_spans(fanout), lambda s: s < n))


def _levels(first: Column, stop: Column) -> Column:
    return F.when(stop > first, F.sequence(first, stop - 1)).otherwise(F.array().cast("array<int>"))


def _shortened(level: DataFrame, fanout: int) -> DataFrame:
    """The next level: each run of nodes becomes one. No group has more rows than the fanout."""
    runs = level.groupBy("tree", _over(F.col("index"), F.lit(fanout).cast("long")).alias("run")).agg(F.sort_array(F.collect_list(F.struct("index", "digest"))).alias("run_nodes"))
    return runs.select("tree", F.col("run").alias("index"), digest(joined(F.col("run_nodes.digest"))).alias("digest"))


def _nodes(leaves: DataFrame, trees: DataFrame, fanout: int) -> DataFrame:
    """All nodes (tree, level, index, digest) above and including the leaves (tree, index, digest) of trees (tree, n)."""
    level, below = 0, materialize(leaves.select("tree", F.lit(0).alias("level"), "index", "digest"), "merkle-level")
    found = below
    most = trees.agg(F.max("n")).first()[0] or 0
    while fanout**level < most:
        wide = trees.where(F.col("n") > F.lit(fanout**level)).select("tree")  # the others are one node by now
        below = _shortened(below.join(broadcast_if_small(wide), "tree", "left_semi"), fanout)
        level += 1
        below = materialize(below.select("tree", F.lit(level).alias("level"), "index", "digest"), "merkle-level")
        found = found.unionByName(below)
    return found


def _tops(nodes: DataFrame, trees: DataFrame, fanout: int) -> DataFrame:
    """(tree, subroot): the one node of the highest level of each tree."""
    high = trees.select("tree", _height(F.col("n"), fanout).alias("level"))
    return nodes.where("index = 0").join(broadcast_if_small(high), ["tree", "level"]).select("tree", F.col("digest").alias("subroot"))


def build(docs: DataFrame, group: str = "lang", order: str = "doc_id", fields: tuple[str, ...] = FIELDS, kept: dict[str, Column] | None = None, fanout: int = FANOUT) -> Manifest:
    """The manifest of the rows; kept are further columns of its leaves, computed in the one pass over the rows."""
    if fanout < 2:
        raise ValueError("a run has two nodes or more")
    own = {"group": F.col(group), "order": F.col(order), "leaf": leaf([F.col(f) for f in fields])}
    first = materialize(docs.select(*(c.alias(f"_{n}") for n, c in own.items()), *(c.alias(n) for n, c in (kept or {}).items())), "merkle-rows")
    placed = numbered(first, ["_group"], ["_order", "_leaf"], "_nth")
    placed = materialize(placed, "merkle-placed")

    sizes = placed.groupBy("_group").agg(F.count(F.lit(1)).alias("n"))
    trees = numbered(sizes, [], ["_group"], "_tree").select((F.col("_tree") - 1).alias("tree"), F.col("_group").alias(group), "n")
    trees = materialize(trees, "merkle-trees")
    named = trees.select("tree", F.col(group).alias("_of"))
    leaves = placed.join(broadcast_if_small(named), placed["_group"].eqNullSafe(named["_of"])).select("tree", (F.col("_nth") - 1).alias("index"), F.col("_leaf").alias("leaf"), *(kept or {}))
    leaves = materialize(leaves, "merkle-leaves")

    nodes = _nodes(leaves.select("tree", "index", F.col("leaf").alias("digest")), trees.select("tree", "n"), fanout)
    trees = materialize(trees.join(_tops(nodes, trees, fanout), "tree").select("tree", group, "n", "subroot"), "merkle-subroots")
    count = trees.count()
    top = docs.sparkSession.createDataFrame([(TOP, count)], "tree long, n long")
    above = _nodes(trees.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("index"), F.col("subroot").alias("digest")), top, fanout)
    root = _tops(above, top, fanout).first() if count else None
    return Manifest(leaves, nodes.unionByName(above), trees, bytes(root.subroot) if root else None, group, fanout)


def coordinates(index: Column, n: Column, first: Column, stop: Column, fanout: int) -> Column:
    """(level, index) of the siblings of a leaf on the levels from first to before stop, of a tree with n leaves."""

    def of(level: Column) -> Column:
        span = F.get(_spans(fanout), level)
        mine, last = _over(index, span), _over(n - 1, span)
        start = mine - mine % fanout
        run = F.sequence(start, F.least(start + (fanout - 1), last))
        return F.transform(F.filter(run, lambda i: i != mine), lambda i: F.struct(level.alias("level"), i.alias("index")))

    return F.flatten(F.transform(_levels(first, stop), of))


def siblings(members: DataFrame, nodes: DataFrame, fanout: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(tree, index, found array<struct<level, index, digest>>) of the members (tree, index, n), in order of level and index.

    Nodes of the levels from `cut` on are broadcast; their number is counted and stands for at most `limit` bytes. A node below
    has at most a few leaves in as many as that limit holds, so the joins that shuffle have no hot key.
    """
    counts = {r.level: r["count"] for r in nodes.groupBy("level").count().collect()}  # a row per level
    cut = max(counts, default=0) + 1
    while cut and sum(n for k, n in counts.items() if k >= cut - 1) * NODE_BYTES <= limit:
        cut -= 1
    at = members.select("tree", "index", "n", _height(F.col("n"), fanout).alias("_high")).repartition("tree", "index")

    def found(first: Column, stop: Column, among: DataFrame) -> DataFrame:
        wanted = at.select(F.col("tree"), F.col("index").alias("_leaf"), F.explode(coordinates(F.col("index"), F.col("n"), first, stop, fanout)).alias("c")).select("tree", "_leaf", "c.level", "c.index")
        met = wanted.join(among, ["tree", "level", "index"])
        return met.groupBy("tree", "_leaf").agg(F.collect_list(F.struct("level", "index", "digest")).alias("found"))

    high = found(F.lit(cut), F.col("_high"), F.broadcast(nodes.where(F.col("level") >= cut)))
    low = found(F.lit(0), F.least(F.lit(cut), F.col("_high")), nodes.where(F.col("level") < cut)) if cut else None
    out = at.select("tree", "index").join(high.withColumnsRenamed({"_leaf": "index", "found": "_above"}), ["tree", "index"], "left")
    none = F.array().cast(high.schema["found"].dataType)
    parts = [F.coalesce("_above", none)]
    if low is not None:
        out = out.join(low.withColumnsRenamed({"_leaf": "index", "found": "_below"}), ["tree", "index"], "left")
        parts.append(F.coalesce("_below", none))
    return out.select("tree", "index", F.sort_array(F.concat(*parts)).alias("found"))


def own_places(index: Column, n: Column, fanout: int) -> Column:
    """Where a leaf's own path goes through each level below the last one: what its siblings are folded around."""
    none = F.lit(None).cast("binary")
    return F.transform(_levels(F.lit(0), _height(n, fanout)), lambda k: F.struct(k.alias("level"), _over(index, F.get(_spans(fanout), k)).alias("index"), none.alias("digest")))


def fold(leaf_digest: Column, steps: Column) -> Column:
    """The root that a leaf (bytes) and the ordered steps give; a step without a digest is the path's own place."""
    start = F.struct(_hex(leaf_digest).alias("own"), F.lit("").alias("run"), F.lit(0).alias("level"))

    def add(state: Column, step: Column) -> Column:
        same = state.level == step.level
        own = F.when(same, state.own).otherwise(F.sha2(state.run, 256))
        return F.struct(own.alias("own"), F.concat(F.when(same, state.run).otherwise(""), F.coalesce(_hex(step.digest), own)).alias("run"), step.level.alias("level"))

    folded = F.aggregate(steps, start, add, lambda state: F.sha2(state.run, 256))
    return F.when(F.size(steps) == 0, _hex(leaf_digest)).otherwise(folded)


def _steps(found: Column, index: Column, n: Column, fanout: int) -> Column:
    return F.sort_array(F.concat(found, own_places(index, n, fanout)))


def proofs(manifest: Manifest, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The leaves with group, subroot and their proof: the siblings and the steps to the subroot, and those of the subroot to the root.

    tree, index, (kept columns), leaf, (group), subroot, found, steps, top_found, top_steps
    """
    k = manifest.fanout
    count = manifest.trees.count()
    tops = manifest.trees.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("index"), F.lit(count).cast("long").alias("n"))
    above = siblings(tops, manifest.nodes.where(F.col("tree") == TOP), k, limit).select(F.col("index").alias("tree"), F.col("found").alias("top_found"))
    trees = manifest.trees.join(above, "tree").withColumn("top_steps", _steps(F.col("top_found"), F.col("tree"), F.lit(count).cast("long"), k))
    trees = materialize(trees, "merkle-tops")
    members = manifest.leaves.join(broadcast_if_small(trees.select("tree", "n")), "tree")
    below = siblings(members.select("tree", "index", "n"), manifest.nodes.where(F.col("tree") != TOP), k, limit)
    out = manifest.leaves.join(below, ["tree", "index"]).join(broadcast_if_small(trees), "tree")
    return out.withColumn("steps", _steps(F.col("found"), F.col("index"), F.col("n"), k))


def folded_root(leaf_digest: Column) -> Column:
    """The root (hex) that a leaf gives with the steps of a row of proofs()."""
    return fold(F.unhex(fold(leaf_digest, F.col("steps"))), F.col("top_steps"))


def proof_digest() -> Column:
    """One digest (hex) of all siblings of a row of proofs(), level by level up to the root."""
    return F.sha2(F.concat(joined(F.col("found.digest")), joined(F.col("top_found.digest"))), 256)
