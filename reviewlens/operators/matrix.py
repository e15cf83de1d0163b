"""Sums of small dense matrices over a distributed sparse matrix.

The rows of the matrix are MLlib vectors in a DataFrame.  Each task folds its
Arrow batches into a few matrices whose shape depends on model parameters only
(topics, capped vocabulary); these are cut into blocks and added up in a tree
of grouped jobs, so no task ever receives more than ``fan_in`` blocks.
"""

from __future__ import annotations

from typing import Callable

import numpy as np
from pyspark.sql import DataFrame, functions as F

from reviewlens.scale import released

BLOCK_BYTES = 1 << 18
FAN_IN = 32
#: Tasks of a pass for each core: each one hands on matrices of the model's size, however many rows it has.
TASKS = 4
PARTIAL = "name string, block int, part int, data binary"


def csr_chunks(batch, column: int, width: int):
    """(rows, indices, values, starts) pieces of a vector column, bounded in size."""
    struct = batch.column(column)
    if len(struct) and np.asarray(struct.field("type")).max():  # a dense row has no indices: it would count as empty
        raise ValueError("sparse vectors are needed")
    index_lists, value_lists = struct.field("indices"), struct.field("values")
    offsets = np.asarray(index_lists.offsets)
    indices, values = np.asarray(index_lists.values), np.asarray(value_lists.values)
    budget = max(1000, 8_000_000 // max(width, 1))
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + budget, side="right")) - 1
        last = min(max(last, first + 1), rows)
        lo, hi = offsets[first], offsets[last]
        yield slice(first, last), indices[lo:hi], values[lo:hi], offsets[first : last + 1] - lo
        first = last


def times(indices, values, starts, dense):
    """X @ dense for CSR rows, column by column: a column stays in the cache."""
    rows = len(starts) - 1
    row, at = np.repeat(np.arange(rows), np.diff(starts)), indices.astype(np.intp)
    out = np.empty((dense.shape[1], rows))
    for number, column in enumerate(np.ascontiguousarray(dense.T)):
        out[number] = np.bincount(row, values * column[at], rows)
    return out.T


def transpose_times(indices, values, starts, dense, into):
    """into += X.T @ dense for CSR rows."""
    if not len(indices):
        return
    row, at = np.repeat(np.arange(len(starts) - 1), np.diff(starts)), indices.astype(np.intp)
    for number, column in enumerate(np.ascontiguousarray(dense.T)):
        into[:, number] += np.bincount(at, values * column[row], len(into))


def fold(features: DataFrame, width: int, start: Callable, step: Callable, marks: int | None = None) -> dict[str, np.ndarray]:
    """Sum ``step`` over all rows.

    ``start()`` gives a dict of zero matrices; ``step(totals, indices, values,
    starts)`` adds one chunk of rows to them.  Returns the totals of the whole
    matrix.  With ``marks``, the number of a column of integers, the step gets
    the chunk's values of that column as well.
    """

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        totals = start()
        for batch in batches:
            for piece, indices, values, starts in csr_chunks(batch, 0, width):
                more = () if marks is None else (np.asarray(batch.column(marks))[piece],)
                step(totals, indices, values, starts, *more)
        part = TaskContext.get().partitionId()
        names, blocks, data = [], [], []
        for name, matrix in totals.items():
            flat = np.ascontiguousarray(matrix, dtype="float64").reshape(-1)
            for block, at in enumerate(range(0, len(flat), BLOCK_BYTES // 8)):
                names.append(name)
                blocks.append(block)
                data.append(flat[at : at + BLOCK_BYTES // 8].tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(blocks, pa.int32()), pa.array([part] * len(names), pa.int32()),
             pa.array(data, pa.binary())],
            names=["name", "block", "part", "data"],
        )

    def add(table):
        import pyarrow as pa

        total = sum(np.frombuffer(b.as_py(), dtype="float64") for b in table.column("data"))
        first = {n: table.column(n)[0].as_py() for n in ("name", "block", "part")}
        return pa.table({
            "name": pa.array([first["name"]], pa.string()), "block": pa.array([first["block"]], pa.int32()),
            "part": pa.array([first["part"] // FAN_IN], pa.int32()), "data": pa.array([total.tobytes()], pa.binary()),
        })

    parts = features.rdd.getNumPartitions()
    most = TASKS * features.sparkSession.sparkContext.defaultParallelism
    if parts > most:
        features, parts = features.coalesce(most), most
    partials = features.mapInArrow(run, PARTIAL)
    while True:
        group = F.floor(F.col("part") / FAN_IN).alias("g")
        partials = partials.groupBy("name", "block", group).applyInArrow(add, PARTIAL)
        parts = -(-parts // FAN_IN)
        if parts <= 1:
            break
    shapes = {name: matrix.shape for name, matrix in start().items()}
    pieces: dict[str, dict[int, bytes]] = {name: {} for name in shapes}
    for row in released(partials).collect():  # the totals: sized by the model, not by the data
        pieces[row["name"]][row["block"]] = row["data"]
    return {
        name: np.frombuffer(b"".join(pieces[name][i] for i in sorted(pieces[name])), dtype="float64").reshape(shape).copy()
        for name, shape in shapes.items()
    }


def row_arrays(df: DataFrame, features: str, keys: list[str], width: int, compute: Callable, out: str) -> DataFrame:
    """Add an array column computed from each row's vector; only keys are kept."""
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [compute(i, v, s) for _, i, v, s in csr_chunks(batch, 0, width)]
            dense = np.concatenate(rows) if rows else np.zeros((0, 1))
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(0, dense.size + 1, dense.shape[1], dtype="int32")), pa.array(dense.reshape(-1))
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(i + 1) for i in range(len(keys))] + [lists], names=[*keys, out]
            )

    return df.select(features, *keys).mapInArrow(run, f"{schema}, `{out}` array<double>")
