"""Search for short licence notices, with a bounded number of edits.

A notice that may hold k edits is divided into k + 1 parts: at least one of them
occurs unchanged in every match, so the exact parts are the seeds.  Seeds of all
notices are searched for in one pass; around each seed found, the regex library
matches the whole notice with at most k insertions, deletions and substitutions.
Overlapping matches of a notice are one finding.

Texts are normalised first: A-Z become a-z, words are runs of letters, digits and
non-ASCII characters, joined by single spaces.  Findings give the place in words and
in characters of the original text.  Phrases of words are found exactly as well.

Edge cases: a null or empty text has no words and no labels; repeated rows are
scanned each; texts of any length are read whole; other columns are dropped.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import ahocorasick
import regex
from pyspark.sql import DataFrame, functions as F

from reviewlens.llm.common import alnum_words, map_texts

# Phrases that are counted exactly and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Opening or telling words of well-known notices, and how many edits each may hold.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 6),
    ("mit", "licensed under the mit license", 3),
    ("apache", "licensed under the apache license version 2 0", 4),
    ("gpl", "under the terms of the gnu general public license", 4),
    ("lgpl", "gnu lesser general public license", 3),
    ("agpl", "gnu affero general public license", 3),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 8),
    ("mpl", "subject to the terms of the mozilla public license", 4),
    ("cc-by", "creative commons attribution", 2),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", 6),
    ("unlicense", "this is free and unencumbered software released into the public domain", 6),
    ("all-rights-reserved", "all rights reserved", 1),
)

#: A word in a text whose A-Z are as they were.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FINDING = "struct<label:string,notice:string,edits:int,first_word:long,last_word:long,start:long,end:long>"
COLUMNS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "findings")
SCHEMA = (
    "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
    f"findings array<{FINDING}>"
)


@dataclass
class Notice:
    label: str
    text: bytes
    edits: int
    pattern: regex.Pattern


def seeds_of(text: bytes, edits: int) -> list[tuple[int, bytes]]:
    """(offset, part) of the edits + 1 parts of a notice, as equal as can be."""
    cuts = [len(text) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, text[a:b]) for a, b in zip(cuts, cuts[1:])]


class Scanner:
    def __init__(self, notices=NOTICES, phrases=PHRASES):
        self.phrases = [(f" {p} ".encode(), label) for p, label in phrases.items()]
        self.notices: list[Notice] = []
        seeds: dict[str, list[tuple[int, int]]] = {}
        for label, words, edits in notices:
            text = words.encode()
            pattern = regex.compile(rb"(?b)(?:" + regex.escape(text) + rb"){e<=%d}" % edits)
            for offset, part in seeds_of(text, edits):
                seeds.setdefault(part.decode(), []).append((len(self.notices), offset))
            self.notices.append(Notice(label, text, edits, pattern))
        self.seeds = ahocorasick.Automaton()
        for part, places in seeds.items():
            self.seeds.add_word(part, (len(part), places))
        if seeds:
            self.seeds.make_automaton()

    def base(self, line: bytes) -> list[tuple[int, str]]:
        """(offset, label) of every place of a phrase in `` w w w ``."""
        found = []
        for phrase, label in self.phrases:
            at = line.find(phrase)
            while at >= 0:
                found.append((at, label))
                at = line.find(phrase, at + 1)
        return found

    def windows(self, line: bytes) -> dict[int, list[tuple[int, int]]]:
        """For each notice the merged stretches of the line in which it may lie."""
        raw: dict[int, list[tuple[int, int]]] = {}
        for end, (length, places) in self.seeds.iter(line.decode("latin-1")):
            start = end - length + 1
            for number, offset in places:
                notice = self.notices[number]
                low = max(0, start - offset - notice.edits)
                high = min(len(line), start - offset + len(notice.text) + 2 * notice.edits)
                stretches = raw.setdefault(number, [])
                if stretches and low <= stretches[-1][1]:
                    stretches[-1] = (min(low, stretches[-1][0]), max(high, stretches[-1][1]))
                else:
                    stretches.append((low, high))
        return raw

    def fuzzy(self, line: bytes) -> list[tuple[int, int, int, int]]:
        """(notice, edits, start, end) of the matches, one of overlapping ones."""
        found = []
        for number, stretches in self.windows(line).items():
            notice, last = self.notices[number], -1
            for low, high in sorted(stretches):
                # the best match may lie behind others: both sides of it are searched as well
                waiting, ends = [(max(low, last), high)], []
                while waiting:
                    at, stop = waiting.pop()
                    match = notice.pattern.search(line, at, stop) if at < stop else None
                    if not match:
                        continue
                    found.append((number, sum(match.fuzzy_counts), match.start(), match.end()))
                    ends.append(max(match.end(), at + 1))
                    waiting += [(ends[-1], stop), (at, match.start())]  # the earlier side first
                last = max([last, *ends])
        return found

    def scan(self, text: str | None):
        words = alnum_words(text)
        line = b" " + b" ".join(words) + b" "
        base = self.base(line)
        places = [at for at, _ in base]
        first, last = (line.count(b" ", 0, f(places)) if places else None for f in (min, max))
        findings = []
        fuzzy = self.fuzzy(line) if words else []
        place = [m.span() for m in WORD.finditer(text)] if fuzzy else []
        for number, edits, start, end in fuzzy:
            begin = max(0, line.count(b" ", 0, start + 1) - 1)
            stop = min(len(words) - 1, max(begin, line.count(b" ", 0, end - 1) - 1))
            findings.append({
                "label": self.notices[number].label, "notice": self.notices[number].text.decode(), "edits": edits,
                "first_word": begin, "last_word": stop, "start": place[begin][0], "end": place[stop][1],
            })
        return (
            len(words), len(base), first, last,
            sorted({label for _, label in base}), findings,
        )


def scan(documents: DataFrame, notices=NOTICES, phrases=PHRASES) -> DataFrame:
    """Exact places of phrases and fuzzy findings of notices in every document."""

    def build():
        scanner = Scanner(notices, phrases)

        def step(texts):
            rows = [scanner.scan(text) for text in texts]
            return {name: [r[k] for r in rows] for k, name in enumerate(COLUMNS)}

        return step

    return map_texts(documents, build, SCHEMA)


def digest(scanned: DataFrame) -> DataFrame:
    """Counts, labels and a score: 1 for an exact phrase, less with more edits, else 0."""
    fuzzy = F.transform("findings", lambda f: f["label"])
    size = F.aggregate(
        "findings", F.lit(0.0),
        lambda best, f: F.greatest(best, 1.0 - f["edits"].cast("double") / F.length(f["notice"])),
    )
    return scanned.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union("base_labels", fuzzy)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(size).alias("score"),
        "findings",
    )
