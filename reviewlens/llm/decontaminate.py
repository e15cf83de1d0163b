"""Benchmark decontamination with one Aho-Corasick automaton over test items.

Items and documents are normalised alike: A-Z become a-z and every other ASCII
character that is no letter or digit separates words.  Each item becomes windows
of ``window`` consecutive words (a shorter item is one window of all its words).
The windows form one automaton whose alphabet is the benchmark's words, so a text
is read once, word by word, whatever the number of items; matches are mapped back
to character offsets of the original text.

Edge cases: a null or empty text, or one without words, has no hits; a null item
or one without words is never found; the words of an item whose id is null are hit, but
it isn't listed, as it has no id; the same
item in several rows counts once; a benchmark without rows hits nothing; other
columns of the documents, whatever their names, are passed through only by
``remove_contaminated``.
"""

from __future__ import annotations

import re
from itertools import repeat

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from reviewlens.llm.common import alnum_words, keep_rows, map_texts

#: Words of one window.
WINDOW = 10
#: Windows of one automaton (about 100 bytes each).  A larger benchmark is scanned
#: for by several automata, so that no single broadcast grows with it.
AUTOMATON_WINDOWS = 400_000

#: A word in a text whose A-Z are as they were.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SCAN_SCHEMA = (
    "n_words long, n_hit long, items array<string>, "
    "spans array<struct<first_word:long,last_word:long,start:long,end:long>>"
)


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(words, items): the distinct windows and the ids of the items they occur in."""

    def run(batches):
        for batch in batches:
            found: list[tuple[str, str]] = []
            for item, text in zip(*(column.to_pylist() for column in batch.columns)):
                words = [w.decode("utf-8", "surrogatepass") for w in alnum_words(text)]
                found += ((" ".join(words[i : i + window]), item) for i in range(max(1, len(words) - window + 1)) if words)
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.string()) for k in (0, 1)], ["words", "item"])

    items = benchmark.where(F.col("text").isNotNull())
    items = items.select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    found = items.mapInArrow(run, "words string, item string")
    return found.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items"))


class Matcher:
    """The automaton of a set of windows, over numbers that stand for words."""

    def __init__(self, windows: list[tuple[str, list[str]]]):
        self.codes: dict[bytes, int] = {}
        self.found = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for words, items in windows:
            parts = words.encode("utf-8", "surrogatepass").split(b" ")
            key = tuple(self.codes.setdefault(w, len(self.codes) + 1) for w in parts)
            self.found.add_word(key, (len(parts), items))
        if windows:
            self.found.make_automaton()
        self.any = bool(windows)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged (first word, last word) of the hits, and the items found."""
        if not self.any or not words:
            return [], set()
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        for last, (length, names) in self.found.iter(tuple(map(self.codes.get, words, repeat(0)))):
            first = last - length + 1
            items.update(names)
            while spans and spans[-1][1] + 1 >= first:
                before = spans.pop()
                first, last = min(first, before[0]), max(last, before[1])
            spans.append((first, last))
        return spans, items


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if merged and first <= merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], max(merged[-1][1], last))
        else:
            merged.append((first, last))
    return merged


def _automata(documents: DataFrame, benchmark: DataFrame, window: int, automaton_windows: int) -> list:
    """Broadcast lists of windows, each of about ``automaton_windows`` at most."""
    context = documents.sparkSession.sparkContext
    windows = benchmark_windows(benchmark, window).cache()
    groups = max(1, -(-windows.count() // automaton_windows))
    parts = []
    for group in range(groups):
        rows = windows.where(F.pmod(F.xxhash64("words"), F.lit(groups)) == group).collect()
        parts.append(context.broadcast([(r["words"], list(r["items"])) for r in rows]))
    windows.unpersist()
    return parts


def scan(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, automaton_windows: int = AUTOMATON_WINDOWS) -> DataFrame:
    """Hits of every document, without a shuffle of the documents.

    Returns ``doc_id, n_words, n_hit, items, spans``; spans hold word and character
    offsets of the original text and don't overlap.  A benchmark of several automata
    is scanned for by one after the other within each batch.
    """
    parts = _automata(documents, benchmark, window, automaton_windows)

    def build():
        matchers = [Matcher(part.value) for part in parts]

        def step(texts):
            rows = [_row(matchers, text) for text in texts]
            return {name: [r[k] for r in rows] for k, name in enumerate(("n_words", "n_hit", "items", "spans"))}

        return step

    return map_texts(documents, build, SCAN_SCHEMA)


def _row(matchers: list[Matcher], text: str | None):
    words = alnum_words(text)
    spans, names = matchers[0].scan(words)
    for matcher in matchers[1:]:
        more, others = matcher.scan(words)
        spans, names = _merge(spans + more), names | others
    place = [m.span() for m in WORD.finditer(text)] if spans else []
    return len(words), sum(b - a + 1 for a, b in spans), sorted(names), [
        {"first_word": a, "last_word": b, "start": place[a][0], "end": place[b][1]} for a, b in spans
    ]


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, automaton_windows: int = AUTOMATON_WINDOWS) -> DataFrame:
    """The documents, with all their columns, without those that hold a window of a test item."""

    def without_hits(part):
        def build():
            matcher = Matcher(part.value)
            return lambda texts: [not matcher.scan(alnum_words(text))[0] for text in texts]

        return build

    for part in _automata(documents, benchmark, window, automaton_windows):
        documents = keep_rows(documents, without_hits(part))
    return documents


def digest(scanned: DataFrame) -> DataFrame:
    """One row of counts for each document of ``scan``."""
    return scanned.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
