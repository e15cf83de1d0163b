"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
from typing import Callable, Iterator, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from reviewlens.scale import released

#: Every ASCII byte that is not a digit or letter becomes a space; A-Z become a-z.
#: Bytes of multi-byte characters stay as they are.
ALNUM_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
#: Only A-Z become a-z.
LOWER_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder of ``spark.checkpoint.dir`` and cut the lineage.

    A folder of our own is used only where the session names none, on one machine.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="reviewlens-ckpt-"))
    return released(df).checkpoint()


def alnum_words(text: str | None) -> list[bytes]:
    """Words of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z became a-z; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(ALNUM_FOLD).split() if text else []


def space_words(text: str | None) -> list[bytes]:
    """Words of ``[^\\x20\\x09-\\x0D]+`` after A-Z became a-z; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER_FOLD).split() if text else []


def map_texts(documents: DataFrame, build: Callable[[], Callable[[list], dict]], columns: str) -> DataFrame:
    """``doc_id`` and further columns computed from ``text``, batch by batch, without a shuffle.

    ``build()`` runs once in each task and returns the function from a list of texts
    (or nulls) to the values of each column.  Ids pass through as they are.
    """
    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = StructType.fromDDL("doc_id long, " + columns)
    fields = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = build()
        for batch in batches:
            values = step(batch.column(1).to_pylist())
            rest = [pa.array(values[f.name], f.type) for f in list(fields)[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *rest], schema=fields)

    return slim.mapInArrow(run, schema)


def keep_rows(documents: DataFrame, build: Callable[[], Callable[[list], list[bool]]]) -> DataFrame:
    """The documents, with all their columns, for whose ``text`` the function says true."""
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = build()
        for batch in batches:
            yield batch.filter(pa.array(step(batch.column(at).to_pylist()), pa.bool_()))

    return documents.mapInArrow(run, documents.schema)


def id_bucket(column: Column, buckets: int) -> Column:
    """crc32 of the id as text, modulo ``buckets``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit(""))), F.lit(buckets))


def mix64(values: np.ndarray) -> np.ndarray:
    """A fixed mixing of 64-bit integers (splitmix finaliser)."""
    with np.errstate(over="ignore"):
        z = values.astype(np.uint64, copy=True)
        z ^= z >> np.uint64(30)
        z *= np.uint64(0xBF58476D1CE4E5B9)
        z ^= z >> np.uint64(27)
        z *= np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return z


#: Bytes of text a task turns into words at once, and bytes hashed at once.
SLICE_BYTES, HASHED_BYTES = 1 << 20, 1 << 16

_BYTE_VALUES = mix64(np.arange(5000, 5256, dtype=np.uint64))
_STEP = 0xD1342543DE82EF95
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of a step and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        made = []
        for base in (_STEP, pow(_STEP, -1, 1 << 64)):
            steps = np.full(max(n, HASHED_BYTES), base, np.uint64)
            steps[0] = 1
            made.append(np.cumprod(steps, dtype=np.uint64))
        _POWERS[:] = made
    return _POWERS[0][:n], _POWERS[1][:n]


class Words(NamedTuple):
    """The words of a column of texts: their places in ``raw``, 64-bit hashes and texts."""

    raw: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    #: first word of each text, and the number of all words
    firsts: np.ndarray

    def word(self, at: int) -> bytes:
        return self.raw[self.starts[at] : self.ends[at]].tobytes()


def words_of(texts: pa.Array, fold: np.ndarray, blank: np.ndarray) -> Words:
    """Runs of bytes that are not ``blank`` after each byte went through ``fold``; null has none."""
    texts = texts.fill_null("").cast(pa.binary())
    if not len(texts):
        texts = pa.array([b""], pa.binary())
    _, offsets, values = texts.buffers()
    offsets = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    values = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    raw = fold[values[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    filled = ~blank[raw]
    first, last = filled.copy(), filled.copy()
    first[1:] &= ~filled[:-1]
    last[:-1] &= ~filled[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(raw))]  # a text ends the word before it
    first[inner], last[inner - 1] = filled[inner], filled[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(raw, starts, ends, _word_hashes(raw, starts, ends), np.searchsorted(starts, offsets))


def _word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    hashes = np.empty(len(starts), np.uint64)
    low = 0
    with np.errstate(over="ignore"):
        while low < len(starts):
            high = max(low + 1, int(np.searchsorted(ends, starts[low] + HASHED_BYTES, "right")))
            at, end = starts[low], ends[high - 1]
            power, inverse = _powers(int(end - at))
            sums = np.zeros(end - at + 1, np.uint64)
            np.cumsum(_BYTE_VALUES[raw[at:end]] * power, dtype=np.uint64, out=sums[1:])
            own = starts[low:high] - at
            hashes[low:high] = mix64((sums[ends[low:high] - at] - sums[own]) * inverse[own])
            low = high
    return hashes


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with a bounded number of bytes in a text column, or of one row."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        ends, low = np.cumsum(sizes), 0
        while low < batch.num_rows:
            before = ends[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
            yield batch.slice(low, high - low)
            low = high


class BitTable:
    """A set of hashes of which no member is ever missed; its size is a power of two."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @classmethod
    def empty(cls, bits: int) -> BitTable:
        return cls(np.zeros(bits // 64, np.uint64))

    @staticmethod
    def _places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
        turned = mix64(hashes)
        return [(part & np.uint64(bits - 1)) for part in (turned, turned >> np.uint64(31), turned * np.uint64(3) >> np.uint64(17))]

    def add(self, hashes: np.ndarray) -> None:
        for place in self._places(hashes, len(self.words) * 64):
            np.bitwise_or.at(self.words, place >> np.uint64(6), np.uint64(1) << (place & np.uint64(63)))

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for place in self._places(hashes, len(self.words) * 64):
            found &= (self.words[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
        return found


def bit_table(hashes: DataFrame, bits: int) -> BitTable:
    """The bit table of the column ``hash``, put together from parts of one task each."""

    def run(batches):
        table = BitTable.empty(bits)
        for batch in batches:
            table.add(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        filled = np.flatnonzero(table.words)
        yield pa.RecordBatch.from_arrays([pa.array(filled), pa.array(table.words[filled].view(np.int64))], ["place", "word"])

    parts = hashes.select("hash").mapInArrow(run, "place long, word long")
    found = parts.groupBy("place").agg(F.bit_or("word").alias("word")).toArrow()
    table = BitTable.empty(bits)
    table.words[found.column("place").to_numpy()] = found.column("word").to_numpy().view(np.uint64)
    return table
