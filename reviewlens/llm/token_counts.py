"""Token counts by byte-pair merging, without making identifiers.

A word's symbols form a linked list; a heap holds the adjacent pairs that can be
merged, by rank and then place.  The lowest pair is popped again and again; pairs
whose symbols have changed meanwhile are passed over.  The count is the number of
initial symbols minus the merges done.  Texts are cut into words as the vocabulary
file says (NFC, lower case, its pattern, bytes as symbols, an end-of-word symbol).
Counts of words are remembered in a table of bounded size.

Edge cases: a null or empty text has 0 tokens and 0 bytes; special strings inside a
text are one token each; a text of white space has 0 tokens; repeated rows are
counted each; other columns are dropped.
"""

from __future__ import annotations

import heapq
import json
import re as plain_re
import unicodedata

import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from reviewlens.llm.common import map_texts

#: Words and space-delimited pieces whose counts a worker remembers at once.
REMEMBERED_WORDS, REMEMBERED_PIECES = 600_000, 300_000
#: Separators of Python's split() that the vocabulary's \s does not know.
ODD_SPACE = plain_re.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte, as byte-level vocabularies write it."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class WordMerger:
    """Number of tokens of one word."""

    def __init__(self, merges: list, end_of_word: str):
        self.ranks = {(a, b): i for i, (a, b) in enumerate(merges)}
        self.symbols = byte_symbols()
        self.end = end_of_word

    def count(self, word: str) -> int:
        parts = [self.symbols[b] for b in word.encode("utf-8", "surrogatepass")]
        if not parts:
            return 0
        parts[-1] += self.end
        n = len(parts)
        if n == 1:
            return 1
        ranks = self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j >= n or parts[j] != right:
                continue  # one of the two was merged meanwhile
            parts[i] = joined = left + right
            parts[j] = None
            after[i] = k = after[j]
            merges += 1
            if k < n:
                before[k] = i
                if (r := ranks((joined, parts[k]))) is not None:
                    heapq.heappush(heap, (r, i, joined, parts[k]))
            h = before[i]
            if h >= 0 and (r := ranks((parts[h], joined))) is not None:
                heapq.heappush(heap, (r, h, parts[h], joined))
        return n - merges


class TextCounter:
    """Number of tokens of a text, by the content of a vocabulary file."""

    def __init__(self, vocabulary: str):
        data = json.loads(vocabulary)
        model = data["model"]
        self.merger = WordMerger(model["merges"], model["end_of_word_suffix"] or "")
        split = data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words_of = regex.compile(split).findall
        special = [t["content"] for t in data["added_tokens"]]
        self.special = plain_re.compile("(" + "|".join(map(plain_re.escape, special)) + ")") if special else None
        self.marks = tuple(special)
        self.word_counts: dict[str, int] = {}
        self.piece_counts: dict[str, int] = {}

    def _piece(self, piece: str) -> int:
        """Tokens of a piece of text without white space, or of a whole odd text."""
        folded = unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()
        total, known = 0, self.word_counts
        for word in self.words_of(folded):
            n = known.get(word)
            if n is None:
                n = self.merger.count(word)
                if len(word) <= 64:
                    if len(known) >= REMEMBERED_WORDS:
                        known.clear()
                    known[word] = n
            total += n
        return total

    def _ordinary(self, text: str) -> int:
        if ODD_SPACE.search(text):
            return self._piece(text)
        pieces, known = text.split(), self.piece_counts
        counts = list(map(known.get, pieces))
        if None in counts:
            for i, n in enumerate(counts):
                if n is None:
                    piece = pieces[i]
                    counts[i] = n = self._piece(piece)
                    if len(piece) <= 64:
                        if len(known) >= REMEMBERED_PIECES:
                            known.clear()
                        known[piece] = n
        return sum(counts)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special and any(mark in text for mark in self.marks):
            return sum(1 if part in self.marks else self._ordinary(part) for part in self.special.split(text) if part)
        return self._ordinary(text)


_COUNTERS: dict[str, TextCounter] = {}


def _counter(name: str) -> TextCounter:
    """The counter of a shipped vocabulary file, kept as long as the Python worker."""
    if name not in _COUNTERS:
        with open(SparkFiles.get(name), encoding="utf-8") as file:
            _COUNTERS[name] = TextCounter(file.read())
    return _COUNTERS[name]


def count_tokens(documents: DataFrame, vocabulary_path: str, limit: int = 2048) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of each row of the documents.

    The vocabulary file is shipped to the executors once; its size does not depend
    on the data.
    """
    name = vocabulary_path.rsplit("/", 1)[-1]
    documents.sparkSession.sparkContext.addFile(vocabulary_path)

    def build():
        counter = _counter(name)

        def step(texts):
            tokens = [counter.count(t) for t in texts]
            return {
                "n_bytes": [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts],
                "n_tokens": tokens,
                "over_limit": [n > limit for n in tokens],
            }

        return step

    return map_texts(documents, build, "n_bytes long, n_tokens long, over_limit boolean")
