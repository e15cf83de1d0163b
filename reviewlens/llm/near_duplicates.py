"""Near-duplicate documents by SetSketch registers, a joint likelihood and full sets.

A document is the set of its distinct shingles of consecutive words.  Each register of
its sketch holds a truncated logarithm of the least exponential value over the set:
``clip(floor(1 - log_b x), 0, q + 1)``.  Registers of a union are the maxima of the
registers, and two sets agree in a register with about the probability of their
Jaccard similarity.  Bands of registers are hashed; sets that agree in a band meet.

1.  Equal sets are one class, named by a hash of the whole set.
2.  Classes meet in band buckets; buckets with the same members are looked at once.
    In a bucket the similarity is estimated from the numbers of registers that are
    greater, less and equal, jointly with the set sizes, by maximum likelihood; what
    lies far below the threshold is dropped, and the rest is thinned to a spanning
    forest.  A large bucket is divided into pairs of chunks.
3.  The components of those candidate edges are compared on their full sets, and the
    components of the confirmed links are the answer.

With 25 bands of 5 registers a pair at a similarity of 0.8 meets in no band with a
probability of 5e-5; the estimate at 0.8 lies below 0.6 with less than 1e-7.

Sets are held as 64-bit hashes of shingles.  Edge cases: a text with fewer words than
a shingle is one shingle; a null text, or one without words, is an empty set, linked
with nothing, and its own component; rows that repeat an id and text share a result; a
null id is reached by others under the least id that is not null, and is null where
there is none; other columns are dropped, or kept as they are by ``first_of_groups``.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from reviewlens.llm.common import checkpointed, mix64, space_words
from reviewlens.llm.grouping import components, forest, in_units, units

#: Registers, and rows of a band; the registers beyond whole bands help the estimate.
REGISTERS, BAND = 128, 5
#: Base, rate and largest value of the registers (two bytes each).
BASE, RATE, LARGEST = 1.001, 20.0, 65_534
#: Candidates are dropped when their estimate is this much below the threshold.
MARGIN = 0.2
#: Sketches, and full sets, that are compared with each other in one unit.
SKETCH_CHUNK, SET_CHUNK = 1024, 512
#: Words hashed at once.
BLOCK_WORDS = 65_536

_MULTIPLIERS = mix64(np.arange(1, REGISTERS + 1, dtype=np.uint64)) | np.uint64(1)
_BYTE = mix64(np.arange(1000, 1256, dtype=np.uint64))
_PRIME = 0x9E3779B97F4A7C15
_INVERSE = pow(_PRIME, -1, 1 << 64)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the prime and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        made = []
        for base in (_PRIME, _INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            made.append(np.cumprod(steps, dtype=np.uint64))
        _POWERS[:] = made
    return _POWERS[0][:n], _POWERS[1][:n]


def _window_hashes(words: list[bytes], width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive words, from one running sum over the bytes."""
    raw = np.frombuffer(b" ".join(words), np.uint8)
    spaces = np.flatnonzero(raw == 32)
    starts = np.concatenate(([0], spaces + 1))[: len(words) - width + 1]
    ends = np.concatenate((spaces, [len(raw)]))[width - 1 :]
    power, inverse = _powers(len(raw))
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * power, dtype=np.uint64)))
        return mix64((sums[ends] - sums[starts]) * inverse[starts])


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    words = space_words(text)
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return _window_hashes(words, len(words))
    parts = [
        _window_hashes(words[at : at + BLOCK_WORDS + width - 1], width)
        for at in range(0, len(words) - width + 1, BLOCK_WORDS)
    ]
    return np.unique(np.concatenate(parts))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The registers of a set that is not empty."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 2048):
            values = shingles[at : at + 2048, None] * _MULTIPLIERS
            np.minimum(least, values.min(axis=0), out=least)
    uniform = (least >> np.uint64(11)).astype(np.float64) / 2**53
    exponential = -np.log1p(-uniform) / RATE
    exponential = np.maximum(exponential, 1e-300)
    return np.clip(np.floor(1 - np.log(exponential) / math.log(BASE)), 0, LARGEST + 1).astype(np.uint16)


def merge(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(one, other)


def estimate(greater: np.ndarray, less: np.ndarray, equal: np.ndarray, size: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Jaccard similarity with the greatest joint likelihood of the register comparisons."""
    u = size / (size + other)
    v = 1 - u

    def differ(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)

    def likelihood(j):
        more, fewer = differ(u - v * j), differ(v - u * j)
        tiny = 1e-12
        return (
            greater * np.log(np.maximum(more, tiny)) + less * np.log(np.maximum(fewer, tiny))
            + equal * np.log(np.maximum(1 - more - fewer, tiny))
        )

    low, high = np.zeros_like(u), np.minimum(u / v, v / u)
    for _ in range(28):  # the likelihood has one peak
        a, b = low + (high - low) / 3, high - (high - low) / 3
        left = likelihood(a) >= likelihood(b)
        low, high = np.where(left, low, a), np.where(left, b, high)
    return (low + high) / 2


def reaches(
    greater: np.ndarray, less: np.ndarray, equal: np.ndarray, size: np.ndarray, other: np.ndarray, least: float
) -> np.ndarray:
    """Whether ``estimate`` is ``least`` or more: the likelihood, of one peak, doesn't fall there yet."""
    u = size / (size + other)
    v = 1 - u
    share, log_base = (BASE - 1) / BASE, math.log(BASE)

    def differ(x):
        x = np.clip(x, 0, 1)
        return np.maximum(-np.log1p(-x * share) / log_base, 1e-12), share / ((1 - x * share) * log_base)

    (more, more_step), (fewer, fewer_step) = differ(u - v * least), differ(v - u * least)
    slope = (
        equal * (v * more_step + u * fewer_step) / np.maximum(1 - more - fewer, 1e-12)
        - greater * v * more_step / more - less * u * fewer_step / fewer
    )
    return (least <= 0) | ((least <= np.minimum(u / v, v / u)) & (slope >= 0))


def _sketched(documents: DataFrame, width: int) -> DataFrame:
    """One row for each document: ``doc_id, row_hash, n_shingles, node, registers``."""

    def run(batches):
        for batch in batches:
            sizes, nodes, registers = [], [], []
            for text in batch.column(2).to_pylist():
                found = shingle_set(text, width)
                sizes.append(len(found))
                nodes.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                registers.append(sketch(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(registers, pa.binary())],
                ["doc_id", "row_hash", "n_shingles", "node", "registers"],
            )

    return _keyed(documents).mapInArrow(run, "doc_id long, row_hash long, n_shingles long, node binary, registers binary")


def _keyed(documents: DataFrame, *more: Column) -> DataFrame:
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return documents.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, text).alias("row_hash"), text.alias("text"), *more)


def _band_keys(batches):
    for batch in batches:
        registers = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, REGISTERS).astype(np.uint64)
        keys = np.empty((len(registers), REGISTERS // BAND), np.int64)
        with np.errstate(over="ignore"):
            for band in range(keys.shape[1]):
                value = np.full(len(registers), band, np.uint64)
                for column in registers[:, band * BAND : (band + 1) * BAND].T:
                    value = mix64(value * np.uint64(_PRIME) + column + np.uint64(1))
                keys[:, band] = value.view(np.int64)
        lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32), pa.array(keys.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["node", "keys"])


def _edges(nodes: list[bytes], label: np.ndarray) -> pa.RecordBatch:
    """Each member of a forest with the first member of its tree."""
    own = np.flatnonzero(label != np.arange(len(nodes)))
    ends = [pa.array([nodes[i] for i in own], pa.binary()), pa.array([nodes[label[i]] for i in own], pa.binary())]
    return pa.RecordBatch.from_arrays(ends, ["a", "b"])


def _likely_edges(least: float):
    """In each bucket, a spanning forest of the pairs whose estimate reaches ``least``."""
    agreeing = REGISTERS * max(0.0, least - MARGIN)

    def run(batches):
        for rows in units(batches, 3):
            nodes = rows.column("node").to_pylist()
            registers = np.frombuffer(b"".join(rows.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)
            size = rows.column("n_shingles").to_numpy().astype(np.float64)

            def likely(i, others):
                mine, rest = registers[i], registers[others]
                equal = (rest == mine).sum(axis=1)
                found = equal >= agreeing
                near = np.flatnonzero(found)
                if len(near):
                    greater = (mine > rest[near]).sum(axis=1)
                    less = REGISTERS - greater - equal[near]
                    found[near] = reaches(greater, less, equal[near], np.full(len(near), size[i]), size[others[near]], least)
                return found

            yield _edges(nodes, forest(len(nodes), likely))

    return run


def linked_on_sets(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Labels of the components by 100 * intersection >= percent * union, from exact counts.

    A set is counted against those sets alone that no link has reached yet.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    every, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1  # a shingle of one set alone is in no intersection
    place = np.cumsum(shared) - 1
    ends = np.cumsum(sizes)
    columns = []
    for low, high in zip(ends - sizes, ends):
        mine = column[low:high]
        columns.append(place[mine[shared[mine]]])
    held = np.zeros(int(shared.sum()), bool)

    def linked(i, others):
        possible = 100 * np.minimum(sizes[i], sizes[others]) >= percent * np.maximum(sizes[i], sizes[others])
        asked = others[possible]
        found = np.zeros(len(others), bool)
        if len(asked):
            held[columns[i]] = True
            common = np.array([np.count_nonzero(held[columns[j]]) for j in asked])
            held[columns[i]] = False
            found[possible] = 100 * common >= percent * (sizes[i] + sizes[asked] - common)
        return found

    return forest(len(sets), linked)


def _confirmed_edges(width: int, percent: int):
    """In each unit, a spanning forest of the links that hold on the full sets."""

    def run(batches):
        for rows in units(batches, 3):
            texts = dict(zip(rows.column("node").to_pylist(), rows.column("text").to_pylist()))
            nodes = sorted(texts)
            if len(nodes) > 1:
                yield _edges(nodes, linked_on_sets([shingle_set(texts[x], width) for x in nodes], percent))

    return run


def _labelled(documents: DataFrame, width: int, percent: int) -> DataFrame:
    """``_sketched`` rows without registers, with the component's least row (``first``)."""
    sketched = checkpointed(_sketched(documents, width))
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_hash")
    classes = checkpointed(
        sketched.where("node IS NOT NULL").groupBy("node").agg(
            F.min(first).alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers")
        )
    )
    banded = classes.select("node", "registers").mapInArrow(_band_keys, "node binary, keys array<long>")
    banded = banded.select("node", F.explode("keys").alias("key"))
    buckets = banded.groupBy("key").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("members"), F.min("node").alias("low"), F.max("node").alias("high")
    ).where("n > 1")
    distinct_buckets = buckets.groupBy("n", "members", "low", "high").agg(F.min("key").alias("key")).select("key", "n")
    members = banded.join(distinct_buckets, "key")
    compared = in_units(members, "n", F.col("node"), SKETCH_CHUNK).join(classes.select("node", "registers", "n_shingles"), "node")
    ordered = compared.select("key", "lo", "hi", "node", "registers", "n_shingles").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    clusters = components(ordered.mapInArrow(_likely_edges(percent / 100 - MARGIN), "a binary, b binary"))

    clusters = checkpointed(clusters)
    sizes = clusters.groupBy("root").agg(F.count("*").alias("n")).where("n > 1")
    inside = clusters.join(sizes, "root").join(classes.select("node", "first"), "node")
    inside = in_units(inside, "n", F.col("node"), SET_CHUNK).select(
        F.xxhash64("root").alias("key"), "lo", "hi", "node", "first.row_hash", F.col("first.doc_id").alias("first_id")
    )
    texts = _keyed(documents).join(inside, "row_hash").where(F.col("doc_id").eqNullSafe(F.col("first_id")))
    ordered = texts.select("key", "lo", "hi", "node", "text").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    links = components(ordered.mapInArrow(_confirmed_edges(width, percent), "a binary, b binary"))

    rooted = classes.select("node", "first").join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = checkpointed(rooted)
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    labels = rooted.join(least, "root").select("node", "least")
    return sketched.drop("registers").join(labels, "node", "left")


def groups(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of the documents."""
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id"))
    found = _labelled(documents, width, percent).select("doc_id", "n_shingles", component.alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def first_of_groups(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents, with all their columns, of which each group keeps its least row.

    Rows that repeat an id and text are one document.  Texts without words stay.
    """
    labelled = _labelled(documents, width, percent)
    stays = F.col("node").isNull() | (F.col("row_hash") == F.col("least.row_hash"))
    kept = labelled.where(stays).select("row_hash", F.col("doc_id").alias("kept_id")).distinct()
    # one struct holds the document, so that no name of its columns meets one of ours
    rows = _keyed(documents, F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("document"))
    joined = rows.drop("text").join(kept, "row_hash").where(F.col("kept_id").eqNullSafe(F.col("doc_id")))
    return joined.dropDuplicates(["row_hash", "kept_id"]).select("document.*")
