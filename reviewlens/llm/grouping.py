"""Groups of similar rows without all pairs: bounded units of work and connected components."""

from __future__ import annotations

from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from reviewlens.llm.common import checkpointed


#: Edges of one partition.
ROWS_OF_PARTITION = 10_000


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges ``a, b``; the root is the component's least node.

    Alternating large-star and small-star rounds: each joins and aggregates the edges
    on all executors; the lineage is cut after each round.  Rows of a node are dealt by
    a salt as well, in as many parts as the edges fill partitions: a hub is in no one task.
    The steps have that many tasks too, so that small graphs leave few small files.
    """
    links = checkpointed(_oriented(edges.select("a", "b")))
    before = _fingerprint(links)
    while True:
        parts = 1 + before[0] // ROWS_OF_PARTITION
        links = checkpointed(_small_star(_large_star(links, parts), parts))
        now = _fingerprint(links)
        if now == before:
            break
        before = now
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _oriented(edges: DataFrame) -> DataFrame:
    larger, smaller = F.greatest("a", "b"), F.least("a", "b")
    return edges.where("a <> b").select(larger.alias("a"), smaller.alias("b")).distinct()


def _with_least(links: DataFrame, parts: int) -> DataFrame:
    """The links with ``low``, the least ``b`` of each ``a``; both sides of the join hold the salt."""
    salted = links.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(parts)))
    partial = salted.groupBy("a", "salt").agg(F.min("b").alias("low")).coalesce(parts)
    # a window holds one row for each salt of a node: ``parts`` at most
    least = partial.withColumn("low", F.min("low").over(Window.partitionBy("a"))).coalesce(parts)
    return salted.join(least, ["a", "salt"]).drop("salt").coalesce(parts)


def _large_star(links: DataFrame, parts: int) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_least(both, parts).where("b > a").select(F.col("b").alias("a"), F.least("a", "low").alias("b"))


def _small_star(links: DataFrame, parts: int) -> DataFrame:
    lowest = _with_least(links, parts)
    moved = lowest.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionByName(lowest.select("a", F.col("low").alias("b"))).distinct().coalesce(parts)


def _fingerprint(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def in_units(members: DataFrame, count: str, node: Column, size: int) -> DataFrame:
    """Divide groups with more than ``size`` members into chunks and pair the chunks.

    Adds ``lo, hi``: rows of one group with equal ``lo, hi`` are to be compared with
    each other; every two members of a group meet in one unit at least, and a unit
    has about twice ``size`` members at most, however large the group is.
    """
    chunks = F.ceil(F.col(count) / size).cast("int")
    own = F.pmod(F.xxhash64(node), chunks).cast("int")
    others = F.when(chunks == 1, F.array(F.lit(0))).otherwise(
        F.array_remove(F.sequence(F.lit(0), chunks - 1), own)
    )
    units = members.withColumn("_own", own).withColumn("_other", F.explode(others))
    return units.select(
        *members.columns, F.least("_own", "_other").alias("lo"), F.greatest("_own", "_other").alias("hi")
    )


def units(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each unit; rows arrive sorted by the first ``keys`` columns."""
    waiting: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        changed = np.zeros(batch.num_rows, bool)
        for column in batch.columns[:keys]:
            values = column.to_numpy(zero_copy_only=False)
            changed[1:] |= values[1:] != values[:-1]
        cuts = [0, *np.flatnonzero(changed), batch.num_rows]
        for low, high in zip(cuts, cuts[1:]):
            key = tuple(column[low].as_py() for column in batch.columns[:keys])
            if waiting and key != last:
                yield pa.Table.from_batches(waiting)
                waiting = []
            last = key
            waiting.append(batch.slice(low, high - low))
    if waiting:
        yield pa.Table.from_batches(waiting)


def spanning(linked: np.ndarray) -> np.ndarray:
    """For a symmetric matrix of links, the first member of each member's component."""
    n = len(linked)
    label = np.arange(n)
    with_self = linked | np.eye(n, dtype=bool)
    while True:
        reach = np.where(with_self, label[None, :], n).min(axis=1)
        reach = reach[reach]
        if (reach == label).all():
            return label
        label = reach


def forest(n: int, linked: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """The first member of each member's component, for links that are asked as they are needed.

    ``linked(i, others)`` tells which others are linked with ``i``.  Each member asks
    once, and only about members that no link has reached: a component whose first
    member is linked with all of it takes one question.
    """
    label = np.arange(n)
    unreached = np.arange(n)
    while len(unreached) > 1:
        first, unreached = unreached[0], unreached[1:]
        waiting = [first]
        while waiting and len(unreached):
            hit = linked(waiting.pop(), unreached)
            label[unreached[hit]] = first
            waiting.extend(unreached[hit])
            unreached = unreached[~hit]
    return label
