"""Best-fit decreasing packing of token sequences.

A document's ids are cut into full windows first; each is a sequence of its own.
The remainders of a task, a bounded number at a time, are packed in the order of
decreasing length, each into the open window with the least room that still takes
it, found by a segment tree over remaining capacities.  Holes left by that are
closed by cutting pieces of the emptiest windows, and the last window, if it stays
partly empty, is cut into windows whose lengths are powers of two, which need no
padding.  No shuffle is needed: windows are packed inside each partition.

Edge cases: a null or empty text is the single end id; repeated rows are packed
each; an empty table gives no rows; other columns are dropped.  Texts of any length
are cut; a null id stays null.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, functions as F

from reviewlens.llm.token_counts import byte_symbols

#: Remainders packed together; this bounds a task's memory to about 64 MB of ids.
POOL = 16_384
#: Holes of at most this many ids are padded rather than filled by cutting.
SMALL_HOLE = 8
REMEMBERED_PIECES = 400_000

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


class Encoder:
    """Ids of texts, as little-endian unsigned 32-bit numbers, by a byte-level vocabulary file."""

    def __init__(self, vocabulary: str, pattern: str):
        data = json.loads(vocabulary)
        value = {s: b for b, s in enumerate(byte_symbols())}
        special = {t["content"]: t["id"] for t in data["added_tokens"]}
        ranks = {
            bytes(value[c] for c in token): i for token, i in data["model"]["vocab"].items() if token not in special
        }
        self.library = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.marks = tuple(special)
        self.special = {m: np.array([i], "<u4").tobytes() for m, i in special.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.known: dict[str, bytes] = {}

    def _library(self, text: str) -> bytes:
        return np.array(self.library.encode_ordinary(text), "<u4").tobytes()

    def _ordinary(self, text: str) -> bytes:
        # A single space between other characters always begins a new word of the
        # pattern, so the pieces between such spaces can be looked up one by one.
        if len(" ".join(text.split())) != len(text):
            return self._library(text)
        first, *rest = text.split(" ")
        pieces, known = [" " + p for p in rest], self.known
        found = list(map(known.get, pieces))
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    piece = pieces[i]
                    found[i] = ids = self._library(piece)
                    if len(piece) <= 64:
                        if len(known) >= REMEMBERED_PIECES:
                            known.clear()
                        known[piece] = ids
        return self._library(first) + b"".join(found)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        text = text.encode("utf-8", "replace").decode()
        if self.split and any(mark in text for mark in self.marks):
            return b"".join(self.special.get(part) or self._ordinary(part) for part in self.split.split(text) if part)
        return self._ordinary(text)


class CapacityTree:
    """Open windows by remaining capacity; finds the least capacity that suffices."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.open = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(size + 1)]

    def _change(self, capacity: int, by: int) -> None:
        node = capacity + self.leaves
        while node:
            self.open[node] += by
            node >>= 1

    def add(self, window: int, capacity: int) -> None:
        self.windows[capacity].append(window)
        self._change(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(window, capacity) of a tightest window with room for ``need``; it is removed."""
        node = need + self.leaves
        if not self.open[node]:
            while node > 1 and (node & 1 or not self.open[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.open[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        self._change(capacity, -1)
        return self.windows[capacity].pop(), capacity


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Best-fit decreasing: for each window the positions of its pieces."""
    tree, windows = CapacityTree(size), []
    for piece in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = tree.take(lengths[piece])
        window, capacity = found or (len(windows), size)
        if found is None:
            windows.append([])
        windows[window].append(piece)
        if capacity > lengths[piece]:
            tree.add(window, capacity - lengths[piece])
    return windows


def _fill_holes(windows: list[list[tuple]], size: int) -> list[list[tuple]]:
    """Cut pieces (document, start, ids) of the emptiest windows into the holes of the others."""
    used = [sum(len(p[2]) for p in w) // 4 for w in windows]
    order = sorted(range(len(windows)), key=lambda i: (-used[i], i))
    low, high = 0, len(order) - 1
    while low < high:
        here, donor = order[low], order[high]
        hole = size - used[here]
        if hole <= SMALL_HOLE:
            low += 1
            continue
        if not windows[donor]:
            high -= 1
            continue
        document, start, ids = windows[donor].pop()
        length = len(ids) // 4
        move = min(hole, length)
        if move < length:
            windows[donor].append((document, start, ids[: 4 * (length - move)]))
        windows[here].append((document, start + length - move, ids[4 * (length - move) :]))
        used[here] += move
        used[donor] -= move
    packed = [windows[i] for i in order if windows[i]]
    if packed and SMALL_HOLE < size - sum(len(p[2]) for p in packed[-1]) // 4:
        packed[-1:] = _powers_of_two(packed[-1])
    return packed


def _powers_of_two(pieces: list[tuple]) -> list[list[tuple]]:
    """The pieces of one window, cut into windows whose lengths are powers of two."""
    total = sum(len(p[2]) for p in pieces) // 4
    rest, out = list(pieces), []
    for bit in reversed(range(total.bit_length())):
        need = total & (1 << bit)
        window: list[tuple] = []
        while need:
            document, start, ids = rest.pop(0)
            take = min(need, len(ids) // 4)
            window.append((document, start, ids[: 4 * take]))
            if take < len(ids) // 4:
                rest.insert(0, (document, start + take, ids[4 * take :]))
            need -= take
        if window:
            out.append(window)
    return out


def pack_pool(pieces: list[tuple], size: int) -> list[list[tuple]]:
    """Windows of pieces ``(document, start, ids)``; no piece is longer than ``size``."""
    pieces = sorted(pieces, key=lambda p: (-len(p[2]), p[0][0] is None, p[0][0] or 0, p[1], p[2]))
    found = best_fit([len(p[2]) // 4 for p in pieces], size)
    return _fill_holes([[pieces[i] for i in window] for window in found], size)


_ENCODERS: dict[str, Encoder] = {}


def _encoder(name: str, pattern: str) -> Encoder:
    if name not in _ENCODERS:
        with open(SparkFiles.get(name), encoding="utf-8") as file:
            _ENCODERS[name] = Encoder(file.read(), pattern)
    return _ENCODERS[name]


def pack(documents: DataFrame, vocabulary_path: str, pattern: str, size: int = 1024, end_id: int = 0, pool: int = POOL) -> DataFrame:
    """Pieces of all documents with their place in sequences of at most ``size`` ids."""
    name = vocabulary_path.rsplit("/", 1)[-1]
    documents.sparkSession.sparkContext.addFile(vocabulary_path)
    end = np.array([end_id], "<u4").tobytes()
    columns = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches):
        encoder = _encoder(name, pattern)
        # the high bits of a sequence's number are the task's partition
        following = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        waiting: list[tuple] = []

        def place(window: list[tuple]) -> None:
            nonlocal following
            offset = 0
            for (doc_id, total), start, ids in window:
                length = len(ids) // 4
                rows.append((doc_id, start, length, zlib.crc32(ids), total, following, offset))
                offset += length
            following += 1

        def batch_of_rows() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], columns)
            rows.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encoder.encode(text) + end
                document = (doc_id, len(ids) // 4)
                for at in range(0, len(ids), 4 * size):
                    piece = (document, at // 4, ids[at : at + 4 * size])
                    if len(piece[2]) == 4 * size:
                        place([piece])
                    else:
                        waiting.append(piece)
                if len(waiting) >= pool:
                    for window in pack_pool(waiting, size):
                        place(window)
                    waiting.clear()
            if rows:
                yield batch_of_rows()
        for window in pack_pool(waiting, size):
            place(window)
        if rows:
            yield batch_of_rows()

    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, SCHEMA)
