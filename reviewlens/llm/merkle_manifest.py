"""Merkle manifest of a table, with proofs, from fixed-width substrings of level strings.

Each row is a leaf, the SHA-256 of its fields.  The leaves of a group, in order, are
divided into aligned blocks of 256.  A block keeps each of its levels as one string of
hex digests side by side: 128 characters of a level hash to one digest of the next, so a
level is made from the one below with substrings alone, and the sibling of a node is the
substring beside it.  The last nodes of the blocks are the nodes of the next round, which
is divided into blocks in the same way, until every group has one node, its subroot.
The subroots, in the order of the groups, are once more such a tree; its end is the root.

Proofs come down the same rounds: a block receives the siblings above it and hands them,
behind its own, to its nodes.  Only blocks are joined on the way, and a document's proof
is written when its block is unfolded.  A run of one node hashes that node alone.

A group of any size is spread over all tasks by position; nothing but the root and the
largest number of leaves reaches the driver.  Edge cases: a null field counts as ``-``;
rows of a null group come first; a null order value comes first in its group; rows that
repeat the order value follow the order of their leaves, and whole repeated rows take
consecutive places; an empty table has no rows; other columns are dropped.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from reviewlens.llm.common import checkpointed

#: Levels a block holds, and its leaves.
LEVELS = 8
BLOCK = 1 << LEVELS
#: Characters of a hex digest.
DIGEST = 64
_PATH = "array<struct<before: string, after: string>>"


class Tree(NamedTuple):
    """Block frames by round, from the leaves up: ``g, n, block, rows, levels``."""

    rounds: list[DataFrame]

    def ends(self) -> DataFrame:
        """``g, node``: the last node of every group."""
        found = [r.where(_blocks("n") == 1).select("g", F.element_at("levels", -1).alias("node")) for r in self.rounds]
        frame = found[0]
        for other in found[1:]:
            frame = frame.unionByName(other)
        return frame


def encoded(fields: list[Column]) -> Column:
    """The fields one behind the other: ``-`` for null, else byte count, ``:``, value."""
    texts = [field.cast("string") for field in fields]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def manifest(
    documents: DataFrame, fields: list[str], group: str, order: str, changed: dict[str, Column] | None = None
) -> DataFrame:
    """``<order>, <group>, leaf, subroot, root, proof_sha256, siblings, folded_root, verified``.

    ``changed`` replaces fields by other values after the tree was built, as a stored
    manifest meets a table that was altered since; the folded root starts from them.
    """
    own = encoded([F.col(c) for c in fields])
    later = encoded([(changed or {}).get(c, F.col(c)) for c in fields])
    leaves = documents.select(
        _group_key(F.col(group)).alias("g"), F.col(group).alias("label"), F.col(order).alias("key"),
        F.sha2(own, 256).alias("node"), (F.sha2(later, 256) if changed else F.lit(None).cast("string")).alias("other"),
    )
    placed = _placed(leaves.withColumn("other", F.when(F.col("other") != F.col("node"), F.col("other"))))
    tree = _grown(placed, ["label", "key", "other"])
    subroots = checkpointed(tree.ends())
    above = _grown(_placed(subroots.select(F.lit("").alias("g"), F.col("g").alias("key"), "node")), ["key"])
    top = above.ends().first()

    start = above.ends().select("g", F.array().cast(_PATH).alias("path"))
    upper = _unfolded(above, start).select(F.col("row.key").alias("g"), F.col("row.node").alias("subroot"), "path")
    rows = _unfolded(tree, upper.select("g", "path")).join(upper.select("g", "subroot"), "g")
    folded = F.aggregate(
        "path", F.coalesce("row.other", "row.node"), lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256)
    )
    siblings = F.array_join(F.transform("path", lambda step: F.concat(step["before"], step["after"])), "")
    root = F.lit(top["node"] if top else None).cast("string")
    return rows.select(
        F.col("row.key").alias(order), F.col("row.label").alias(group), F.col("row.node").alias("leaf"), "subroot",
        root.alias("root"), siblings.alias("siblings"), folded.alias("folded_root"),
    ).select(
        order, group, "leaf", "subroot", "root", F.sha2("siblings", 256).alias("proof_sha256"), "siblings", "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def _group_key(group: Column) -> Column:
    """A text that is never null and sorts as the groups do, null first."""
    return F.coalesce(F.concat(F.lit("1"), group.cast("string")), F.lit("0"))


def _placed(leaves: DataFrame) -> DataFrame:
    """Add ``pos``, the place of a leaf in its group, and ``n``, the leaves of the group.

    The rows are sorted over all tasks; a task numbers its own part of a group from the
    number of the group's rows in the tasks before it.  ``turn`` divides rows that repeat
    in everything else.
    """
    turned = leaves.withColumn("turn", F.monotonically_increasing_id())
    order = [F.col("g").asc(), F.col("key").asc_nulls_first(), F.col("node").asc(), F.col("turn").asc()]
    ordered = checkpointed(turned.repartitionByRange(*order).sortWithinPartitions(*order).drop("turn"))
    ordered = ordered.withColumn("task", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id())
    parts = ordered.groupBy("task", "g").agg(F.count("*").alias("rows"), F.min("row").alias("first"))
    whole = Window.partitionBy("g")
    before = F.coalesce(F.sum("rows").over(whole.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("task", "g", (before - F.col("first")).alias("shift"), F.sum("rows").over(whole).alias("n"))
    return ordered.join(parts, ["task", "g"]).withColumn("pos", F.col("row") + F.col("shift")).drop("task", "row", "shift")


def _blocks(nodes: str) -> Column:
    return F.ceil(F.col(nodes) / BLOCK).cast("long")


def _grown(leaves: DataFrame, carried: list[str]) -> Tree:
    """All rounds of blocks over ``g, pos, n, node`` and the columns carried by the leaves."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    rounds, nodes, names = [], leaves, ["node", *carried]
    while True:
        rounds.append(checkpointed(_levelled(nodes, names)))
        most = math.ceil(most / BLOCK)
        if most <= 1:
            return Tree(rounds)
        unfinished = rounds[-1].where(_blocks("n") > 1)
        nodes = unfinished.select("g", F.col("block").alias("pos"), _blocks("n").alias("n"), F.element_at("levels", -1).alias("node"))
        names = ["node"]


def _levelled(nodes: DataFrame, names: list[str]) -> DataFrame:
    """Blocks of one round: ``g, n, block, rows`` in order and ``levels``, one string each."""
    block = F.floor(F.col("pos") / BLOCK).cast("long")
    rows = F.sort_array(F.collect_list(F.struct("pos", *names))).alias("rows")
    blocks = nodes.groupBy("g", "n", block.alias("block")).agg(rows)
    # a block of many is hashed up to a whole block's height, a lone one to its single node
    height = F.when(_blocks("n") > 1, F.lit(LEVELS)).otherwise(F.ceil(F.log2(F.col("n"))).cast("int"))
    steps = F.when(height > 0, F.sequence(F.lit(1), height)).otherwise(F.array().cast("array<int>"))
    first = F.array(F.array_join(F.col("rows.node"), ""))
    levels = F.aggregate(steps, first, lambda made, _: F.concat(made, F.array(_parents(F.element_at(made, -1)))))
    return blocks.withColumn("levels", levels)


def _parents(level: Column) -> Column:
    last = F.ceil(F.length(level) / (2 * DIGEST)).cast("int") - 1
    hashed = F.transform(
        F.sequence(F.lit(0), last), lambda i: F.sha2(F.substr(level, i * (2 * DIGEST) + 1, F.lit(2 * DIGEST)), 256)
    )
    return F.array_join(hashed, "")


def _path(levels: Column, place: Column) -> Column:
    """From the leaf up, the digest before and after a node's ancestors in its block."""

    def step(level: Column, height: Column) -> Column:
        index = F.floor(place / F.pow(F.lit(2), height)).cast("int")
        beside = F.substr(level, index.bitwiseXOR(F.lit(1)) * DIGEST + 1, F.lit(DIGEST))
        right = index.bitwiseAND(F.lit(1)) == 1
        return F.struct(F.when(right, beside).otherwise("").alias("before"), F.when(right, "").otherwise(beside).alias("after"))

    return F.transform(F.slice(levels, 1, F.size(levels) - 1), step)


def _unfolded(tree: Tree, groups: DataFrame) -> DataFrame:
    """``g, row, path`` of every leaf; ``groups`` holds ``g`` and the path above its last node."""
    handed = None
    for blocks in reversed(tree.rounds):
        ended = blocks.where(_blocks("n") == 1).select("g", "block").join(groups, "g")
        above = ended.select("g", "block", "path")
        if handed is not None:
            above = above.unionByName(handed.select("g", F.col("row.pos").alias("block"), "path"))
        opened = blocks.join(above.withColumnRenamed("path", "higher"), ["g", "block"])
        opened = opened.select("g", "levels", "higher", F.posexplode("rows").alias("place", "row"))
        handed = opened.select("g", "row", F.concat(_path(F.col("levels"), F.col("place")), F.col("higher")).alias("path"))
    return handed
