"""Collocations by Toivonen's method: a sample proposes phrases, full passes count them.

A phrase is 2 to 5 consecutive words of one piece of a text, counted for each language.
No phrase is more frequent than a part of it, so:

1.  The phrases that are frequent in an eighth of the documents, by a lowered bound, are
    the proposals.  They are found word by word: a phrase is counted only where both parts
    that lack one word are proposals.
2.  A pass over all documents counts, in the same way, the proposals *and* their negative
    border: the phrases that are no proposals themselves while both parts are.  All single
    words belong to one or the other.
3.  Where a phrase of the border turns out frequent the proposals were incomplete.  A
    further pass counts what contains such a phrase and was not countable before: the
    phrases both of whose parts are known as frequent, or are counted by this pass itself.
    It goes on until the border holds no frequent phrase.  Then none is missed.

Passes know phrases by 64-bit hashes and proposals by a bit table of bounded size; both
err only towards more phrases.  A last pass counts the phrases left, about as many as
are frequent, by their words, so that the counts are exact.  Tasks add their counts up
before the shuffle, so a word or passage that holds a third of all words is one row of a
task; the table is all that is broadcast.

Scores are exact: products are decimals of 38 digits, divided as integers.

Edge cases: a null text is empty; a null language is ``und``, together with rows that say
so; repeated rows count again; ids are not used beyond the choice of the sample; a table
without a frequent phrase, an empty one included, has no rows; other columns are dropped.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from typing import Iterator, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from reviewlens.llm.common import BitTable, Words, bit_table, checkpointed, mix64, slices, words_of
from reviewlens.scale import join_lookup

#: Most words of a phrase.
WORDS = 5
#: One document in so many is in the sample.
SAMPLE = 8
#: The lowered bound lies so many standard deviations below the expected count.
SLACK = 2.0
#: Bounds of the bits of a table; beyond the upper one more phrases are counted, none less.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28
#: Distinct phrases a task holds before it hands them on, by hash and as text; rows handed on at once.
HELD, HELD_TEXTS, EMITTED = 4_000_000, 400_000, 65_536
#: Tasks of the last pass for each core.
TASKS_A_CORE = 2

_PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
_END = 255  # in no UTF-8 text
_FOLD = np.array([_END if b in _PIECE_ENDS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_BLANK = np.isin(np.arange(256), (32, _END))
_TURNS = mix64(np.arange(11, 11 + WORDS, dtype=np.uint64)) | np.uint64(1)


def length_of(hashed: Column) -> Column:
    """Words of the phrase behind a hash: its lowest three bits."""
    return hashed.bitwiseAND(F.lit(7))


def phrase_hashes(words: np.ndarray, seeds: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the phrases of ``length`` words that start at the places."""
    total = seeds[places].copy()
    with np.errstate(over="ignore"):
        for turn in range(length):
            total += words[places + turn] * _TURNS[turn]
    return mix64(total) & ~np.uint64(7) | np.uint64(length)


def countable(
    words: np.ndarray, seeds: np.ndarray, table: BitTable, fresh: BitTable | None = None
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length, the places and hashes of the table's phrases and of their border.

    With ``fresh``, phrases that turned out frequent since, only what an earlier pass over
    the table did not count and they, or what this pass counts, make countable.
    """
    none = np.zeros(0, np.int64)
    places, extra = np.flatnonzero(words), none
    for length in range(1, WORDS + 1):
        hashes = phrase_hashes(words, seeds, places, length)
        further = phrase_hashes(words, seeds, extra, length)
        yield (length, places, hashes) if fresh is None else (length, extra, further)
        held = table.holds(hashes)
        inside = np.zeros(len(words) + 1, bool)
        inside[places[held]] = True
        following = np.flatnonzero(inside[:-1] & inside[1:])
        if fresh is not None:
            inside[places[~held][fresh.holds(hashes[~held])]] = True
            inside[extra] = True
            extra = np.setdiff1d(np.flatnonzero(inside[:-1] & inside[1:]), following, assume_unique=True)
        places = following


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))


def _in_few_tasks(texts: DataFrame) -> DataFrame:
    """Texts in a number of tasks that does not grow with the input.

    Each task hands on the frequent phrases that it met, most of them once: as many rows
    as tasks times phrases.
    """
    return texts.coalesce(TASKS_A_CORE * texts.sparkSession.sparkContext.defaultParallelism)


class Chunk(NamedTuple):
    """Documents as one row of word hashes, 0 at the end of each piece, with seeds of their languages."""

    words: np.ndarray
    seeds: np.ndarray
    langs: list[str]
    #: text, and number in ``found``, of the word at each place; words of each text
    owner: np.ndarray
    number: np.ndarray
    found: Words

    def phrase(self, place: int, length: int) -> bytes:
        first = int(self.number[place])
        return b" ".join(map(self.found.word, range(first, first + length)))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    known: dict[str, np.uint64] = {}
    for batch in slices(batches, "text"):
        langs = batch.column("lang").to_pylist()
        for lang in langs:
            if lang not in known:
                known[lang] = np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8, key=b"lang").digest(), "little"))
        found = words_of(batch.column("text"), _FOLD, _BLANK)
        n = len(found.hashes)
        owners = np.repeat(np.arange(len(langs)), np.diff(found.firsts))
        piece = np.cumsum(found.raw == _END, dtype=np.int64)[found.starts] + owners
        change = np.zeros(n, bool)
        change[1:] = piece[1:] != piece[:-1]
        places = np.arange(n) + np.cumsum(change)
        size = int(places[-1]) + 2 if n else 1
        words, seeds, owner, number = (np.zeros(size, t) for t in (np.uint64, np.uint64, np.int32, np.int64))
        words[places], owner[places], number[places] = found.hashes | np.uint64(1), owners, np.arange(n)
        seeds[places] = np.array([known[lang] for lang in langs], np.uint64)[owners]
        yield Chunk(words, seeds, langs, owner, number, found)


def _counted(documents: DataFrame, table, least: int, fresh=None, only: int | None = None) -> DataFrame:
    """``hash, count`` of the table's phrases and its border from ``least`` on, and ``lang, count`` of all words.

    With ``fresh``, only what has become countable through it; with ``only``, one length.
    """
    names = ["lang", "hash", "count"]

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size, totals = 0, Counter()

        def merged():
            every = np.concatenate([h for h, _ in held])
            weights = np.concatenate([c for _, c in held])
            held.clear()  # parts of the size of all that is merged
            order = np.argsort(every)
            every = every[order]
            weights = weights[order]
            del order
            starts = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
            return every[starts], np.add.reduceat(weights, starts)

        def emitted(values, counts):
            for at in range(0, len(values), EMITTED):
                part = slice(at, at + EMITTED)
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(len(values[part]), pa.string()), pa.array(values[part].view(np.int64)), pa.array(counts[part])], names
                )

        for chunk in _chunks(batches):
            for lang, n in zip(chunk.langs, np.diff(chunk.found.firsts).tolist()):
                totals[lang] += n
            found = countable(chunk.words, chunk.seeds, table.value, fresh.value if fresh else None)
            hashes = [h for length, _, h in found if only in (None, length)]
            hashes, counts = np.unique(np.concatenate(hashes), return_counts=True)
            if len(hashes):
                held.append((hashes, counts))
                size += len(hashes)
            if size > HELD:
                held.append(merged())
                size = len(held[0][0])
                if size > HELD // 2:
                    yield from emitted(*held.pop())
                    size = 0
        if held:
            yield from emitted(*merged())
        yield pa.RecordBatch.from_arrays([pa.array(totals.keys(), pa.string()), pa.nulls(len(totals), pa.int64()), pa.array(totals.values(), pa.int64())], names)

    rows = _texts(documents).mapInArrow(run, "lang string, hash long, count long")
    # tasks have added up what they can: dealt by hash first, Spark holds no second table of it before the shuffle
    counted = rows.repartition("hash").groupBy("lang", "hash").agg(F.sum("count").alias("count"))
    return counted.where(F.col("hash").isNull() | (F.col("count") >= least))


def _proposals(documents: DataFrame, least: int) -> BitTable:
    """Phrases frequent in the sample by the lowered bound, one more word at a time."""
    context = documents.sparkSession.sparkContext
    sample = checkpointed(documents.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select("lang", "text"))
    expected = least / SAMPLE
    lowered = max(1, math.floor(expected - SLACK * math.sqrt(expected)))
    table = BitTable.empty(LEAST_BITS)
    for length in range(1, WORDS):
        shared = context.broadcast(table)
        counted = checkpointed(_counted(sample, shared, lowered, only=length))
        if length == 1:
            words = counted.where("hash IS NULL").agg(F.sum("count")).first()[0] or 0
            table = BitTable.empty(min(MOST_BITS, max(LEAST_BITS, 1 << words.bit_length())))
        grown = bit_table(counted.where("hash IS NOT NULL"), len(table.words) * 64)
        table = BitTable(table.words | grown.words)
        shared.destroy()
    return table


def _absent(hashes: DataFrame, table) -> DataFrame:
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(~table.value.holds(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))))

    return hashes.select("hash").mapInArrow(run, "hash long")


def frequent_hashes(documents: DataFrame, least: int) -> tuple[DataFrame, DataFrame, int, int]:
    """Hashes of frequent phrases and words, ``lang, n``, the bits of a table, the number of passes."""
    context = documents.sparkSession.sparkContext
    table = context.broadcast(_proposals(documents, least))
    bits = len(table.value.words) * 64
    first = checkpointed(_counted(documents, table, least))
    totals = first.where("hash IS NULL").select("lang", F.col("count").alias("n"))

    frequent, passes = first.where("hash IS NOT NULL").select("hash"), 1
    failures = bit_table(_absent(frequent.where(length_of(F.col("hash")) < WORDS), table), bits)
    if failures.words.any():
        # what this pass counts it takes as frequent, so no phrase is left for another
        fresh = context.broadcast(failures)
        further = checkpointed(_counted(documents, table, least, fresh)).where("hash IS NOT NULL")
        frequent, passes = frequent.unionByName(further.select("hash")), 2
        fresh.destroy()
    table.destroy()
    return frequent, totals, bits, passes


def frequent_phrases(documents: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, length, f`` of all phrases and words with f of ``least`` or more; ``lang, n``."""
    hashes, totals, bits, _ = frequent_hashes(documents, least)
    known = documents.sparkSession.sparkContext.broadcast(bit_table(hashes, bits))

    def run(batches):
        found: Counter = Counter()

        def emitted():
            while found:  # what is handed on is not held beside all that is left
                part = [found.popitem() for _ in range(min(len(found), EMITTED))]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang for (lang, _, _), _ in part], pa.string()),
                        pa.array([phrase.decode("utf-8", "surrogatepass") for (_, phrase, _), _ in part], pa.string()),
                        pa.array([size for (_, _, size), _ in part], pa.int32()), pa.array([count for _, count in part], pa.int64()),
                    ],
                    ["lang", "phrase", "length", "f"],
                )

        for chunk in _chunks(batches):
            for length, places, hashes in countable(chunk.words, chunk.seeds, known.value):
                held = known.value.holds(hashes)
                places, hashes = places[held], hashes[held]
                _, first, which, counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
                other = phrase_hashes(mix64(chunk.words), chunk.seeds, places, length)
                if (other != other[first][which]).any():  # two phrases of one hash
                    first, counts = np.arange(len(places)), np.ones(len(places), np.int64)
                for place, count in zip(places[first].tolist(), counts.tolist()):
                    found[chunk.langs[chunk.owner[place]], chunk.phrase(place, length), length] += count
            if len(found) > HELD_TEXTS:
                yield from emitted()
        yield from emitted()

    rows = _in_few_tasks(_texts(documents)).mapInArrow(run, "lang string, phrase string, length int, f long")
    counted = rows.groupBy("lang", "phrase", "length").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return checkpointed(counted), totals


def collocations(documents: DataFrame, least: int = 100, covered: int = 100, top: int | None = None) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: candidates by score, ``a``, phrase.

    ``least`` is the frequency of a candidate; one that lies in a longer candidate of
    ``covered`` percent of its frequency or more is dropped; ``top`` of each language stay.
    """
    frequent, totals = frequent_phrases(documents, least)
    candidates = frequent.where("length > 1")
    words = F.split("phrase", " ")
    cut = F.explode(F.sequence(F.lit(1), F.col("length") - 1))
    cuts = candidates.select("lang", "phrase", "length", F.col("f").alias("a"), words.alias("words"), cut.alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("head"),
        F.array_join(F.slice("words", F.col("k") + 1, F.col("length") - F.col("k")), " ").alias("tail"),
    )
    parts = frequent.select("lang", "phrase", "f")
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    cuts = join_lookup(cuts, totals, "lang", ["phrase"])
    wide = lambda name: f"cast({name} as decimal(38, 0))"
    score = F.expr(f"({wide('1000 * a')} * {wide('n')}) div ({wide('l')} * {wide('r')})")
    lowest = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    longer = candidates.where("length > 2").select("lang", F.col("f").alias("longer"), words.alias("words"))
    shorter = F.explode(F.array(*[F.array_join(F.slice("words", start, F.size("words") - 1), " ") for start in (1, 2)]))
    longest = longer.select("lang", shorter.alias("phrase"), "longer").groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    stays = F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a"))
    kept = lowest.join(longest, ["lang", "phrase"], "left").where(stays)

    order = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), F.col("phrase").asc())
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
