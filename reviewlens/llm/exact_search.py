"""Exact top-k search by inner product with a ball tree in each shard.

Candidates are divided into shards of bounded size.  A task builds a ball tree over
its shard; queries then stream past it in blocks.  A node's upper bound for query q
is q.centre + |q| * radius; a block goes down the tree with the queries whose bound
still reaches their k-th best score, into the child with the higher bounds first.
The search runs twice: first each query in one shard only, which gives a score that
k candidates reach; that score is shared with all other shards, which begin with it
and raise it further.

Scores are exact integers: components become floor(scale * x), and products are
added in 64-bit floats while that is exact, else in 64-bit integers.

Edge cases: vectors that are null, or hold a null or non-finite component, take no
part, nor do rows without an id; a query is compared with vectors of its own length
only; ties go to the smaller id; with fewer candidates than k all are returned; an
empty table gives no rows; rows that repeat an id are candidates each, but never for
a query of that id, and the query is the least of their vectors; other columns are dropped.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from reviewlens.llm.common import checkpointed

#: Vectors of one shard (4 MB of 64 components), queries of one block, vectors of a leaf.
SHARD, BLOCK, LEAF = 8192, 1024, 256
#: Stands for no score; its negative is a 64-bit integer as well.
NONE = -(2**62)
RESULT = "query_id long, vec_id long, score long"


class BallTree:
    """Nodes in an array: centre, radius, rows of a leaf or two children."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.centres: list[np.ndarray] = []
        self.radii: list[float] = []
        self.children: list[tuple[int, int] | None] = []
        self.rows: list[np.ndarray | None] = []
        pending = [(np.arange(len(ids)), -1, 0)]
        while pending:
            rows, parent, side = pending.pop()
            node = len(self.radii)
            if parent >= 0:
                pair = list(self.children[parent])
                pair[side] = node
                self.children[parent] = tuple(pair)
            part = self.vectors[rows].astype(np.float64)
            centre = part.mean(axis=0)
            self.centres.append(centre)
            # a little more, so that rounding never makes a bound too low
            self.radii.append(float(np.sqrt(((part - centre) ** 2).sum(axis=1).max())) * (1 + 1e-9) + 1e-6)
            split = self._split(part) if len(rows) > LEAF else None
            self.rows.append(rows if split is None else None)
            self.children.append(None if split is None else (-1, -1))
            if split is not None:
                pending += [(rows[split], node, 0), (rows[~split], node, 1)]
        self.centre = np.array(self.centres)
        self.radius = np.array(self.radii)

    @staticmethod
    def _split(part: np.ndarray) -> np.ndarray | None:
        """Halves along the line between two far vectors; None if all are equal."""
        far = part[((part - part[0]) ** 2).sum(axis=1).argmax()]
        other = part[((part - far) ** 2).sum(axis=1).argmax()]
        along = part @ (other - far)
        if along.max() == along.min():
            return None
        half = np.zeros(len(part), bool)
        half[np.argsort(along, kind="stable")[: len(part) // 2]] = True
        return half

    def search(self, query_ids: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int):
        """Per query the k best (score, id), of those that reach ``least``."""
        n = len(queries)
        scores = np.full((n, k), NONE, np.int64)
        found = np.full((n, k), np.iinfo(np.int64).max, np.int64)
        as_float = queries.astype(np.float64)
        norms = np.sqrt((as_float**2).sum(axis=1))
        kth = least.copy()
        widest = float(np.abs(self.vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * queries.shape[1]
        exact_in_float = widest < 2**52

        def bound(node: int, who: np.ndarray) -> np.ndarray:
            reach = as_float[who] @ self.centre[node] + norms[who] * self.radius[node]
            return reach + 1e-9 * np.abs(reach) + 1e-6

        pending = [(0, np.arange(n))]
        while pending:
            node, who = pending.pop()
            who = who[bound(node, who) >= kth[who]]
            if not len(who):
                continue
            pair = self.children[node]
            if pair is None:
                self._leaf(self.rows[node], who, query_ids, as_float if exact_in_float else queries, scores, found, kth, k)
            else:
                first, second = bound(pair[0], who).mean(), bound(pair[1], who).mean()
                pair = pair if first < second else pair[::-1]  # the last is taken first
                pending += [(child, who) for child in pair]
        return scores, found

    def _leaf(self, rows, who, query_ids, queries, scores, found, kth, k):
        vectors = self.vectors[rows].astype(queries.dtype)
        got = (queries[who] @ vectors.T).astype(np.int64)
        ids = self.ids[rows]
        got[query_ids[who][:, None] == ids[None, :]] = NONE
        got[got < kth[who][:, None]] = NONE
        live = (got > NONE).any(axis=1)
        if not live.any():
            return
        who, got = who[live], got[live]
        all_scores = np.concatenate([scores[who], got], axis=1)
        all_ids = np.concatenate([found[who], np.broadcast_to(ids, got.shape)], axis=1)
        all_ids = np.where(all_scores == NONE, np.iinfo(np.int64).max, all_ids)
        order = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
        scores[who] = np.take_along_axis(all_scores, order, axis=1)
        found[who] = np.take_along_axis(all_ids, order, axis=1)
        kth[who] = np.maximum(kth[who], scores[who][:, -1])


def _search_partition(k: int):
    """Rows sorted by (dim, shard, kind): the vectors of a shard, then the queries that visit it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, held, at = None, [], None
        for batch in batches:
            dims = batch.column(0).to_numpy()
            shards, kinds, ids, least = (batch.column(i).to_numpy() for i in (1, 2, 3, 4))
            vectors = batch.column(5)
            cuts = np.flatnonzero((np.diff(dims) != 0) | (np.diff(shards) != 0) | (np.diff(kinds) != 0)) + 1
            for low, high in zip([0, *cuts], [*cuts, len(dims)]):
                key = (dims[low], shards[low])
                if key != at:
                    tree, held, at = None, [], key
                part = vectors.slice(low, high - low).flatten().to_numpy().reshape(-1, dims[low])
                if kinds[low] == 0:
                    held.append((ids[low:high], part))
                    continue
                if tree is None:
                    if not held:
                        continue
                    tree = BallTree(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
                    held = []
                for start in range(low, high, BLOCK):
                    stop = min(high, start + BLOCK)
                    queries = ids[start:stop]
                    scores, found = tree.search(queries, part[start - low : stop - low], least[start:stop], k)
                    here = scores > NONE
                    which = np.broadcast_to(queries[:, None], scores.shape)[here]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(which), pa.array(found[here]), pa.array(scores[here])], ["query_id", "vec_id", "score"]
                    )

    return run


def _search(candidates: DataFrame, visits: DataFrame, k: int) -> DataFrame:
    columns = ["dim", "shard", "kind", "id", "least", "vector"]
    rows = candidates.withColumns({"kind": F.lit(0), "least": F.lit(0).cast("long")}).select(columns).unionByName(
        visits.withColumn("kind", F.lit(1)).select(columns)
    )
    spread = rows.repartition("dim", "shard").sortWithinPartitions("dim", "shard", "kind", "id")
    return spread.mapInArrow(_search_partition(k), RESULT)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, shard_size: int = SHARD) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best other rows of each query."""
    number = F.col("embedding").cast("array<double>")
    whole = (
        F.col("vec_id").isNotNull() & number.isNotNull()
        & F.forall(number, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    )
    kept = vectors.where(whole).select(
        F.col("vec_id").cast("long").alias("id"), is_query.alias("is_query"), F.size(number).alias("dim"),
        F.transform(number, lambda x: F.floor(x * scale).cast("long")).alias("vector"),
    ).where("dim > 0")
    kept = checkpointed(kept)  # read four times below
    sizes = kept.groupBy("dim").count().withColumn("shards", F.ceil(F.col("count") / shard_size).cast("int"))
    kept = kept.join(F.broadcast(sizes.select("dim", "shards")), "dim")  # a row for each vector length
    home = F.pmod(F.xxhash64("id"), F.col("shards")).cast("int")
    candidates = kept.select("dim", home.alias("shard"), "id", "vector")
    one = F.min(F.struct("dim", "vector", "shards")).alias("one")
    queries = kept.where("is_query").groupBy("id").agg(one).select("id", "one.*")
    lowest = F.lit(NONE).cast("long")

    at_home = queries.select("dim", home.alias("shard"), "id", "vector", lowest.alias("least"))
    first = checkpointed(_search(candidates, at_home, k))
    shared = first.groupBy("query_id").agg(F.min("score").alias("kth"), F.count("*").alias("n"))
    shared = shared.select(F.col("query_id").alias("id"), F.when(F.col("n") >= k, F.col("kth")).otherwise(lowest).alias("least"))
    elsewhere = queries.where("shards > 1").join(shared, "id", "left").select(
        "dim", home.alias("home"), "id", "vector", F.coalesce("least", lowest).alias("least"),
        F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"),
    ).where("shard <> home")
    second = _search(candidates, elsewhere, k)

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    merged = first.unionByName(second).withColumn("rank", F.row_number().over(best))
    return merged.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
