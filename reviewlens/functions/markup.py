"""Bracket-markup cleaning: whole texts in Arrow batches, single rules as built-in expressions."""

from __future__ import annotations

import re
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# Fixed values: (rule name, pattern, replacement), applied in this order,
# case-insensitive, with '.' matching newlines.
MARKUP_RULES = (
    ("headers", r"\[h[1-6]\](.*?)\[/h[1-6]\]", "$1"),
    ("bold", r"\[b\](.*?)\[/b\]", "$1"),
    ("italic", r"\[i\](.*?)\[/i\]", "$1"),
    ("underline", r"\[u\](.*?)\[/u\]", "$1"),
    ("strike", r"\[s\](.*?)\[/s\]", "$1"),
    ("url_with_text", r"\[url=.*?\](.*?)\[/url\]", "$1"),
    ("url_simple", r"\[url\](.*?)\[/url\]", "$1"),
    ("image", r"\[img\].*?\[/img\]", ""),
    ("quote", r"\[quote\](.*?)\[/quote\]", "$1"),
    ("list", r"\[list\](.*?)\[/list\]", "$1"),
    ("list_item", r"\[\*\](.*?)(?=\[\*\]|\[/list\]|$)", "$1"),
    ("size", r"\[size=.*?\](.*?)\[/size\]", "$1"),
    ("color", r"\[color=.*?\](.*?)\[/color\]", "$1"),
    ("spoiler", r"\[spoiler\](.*?)\[/spoiler\]", "$1"),
    ("code", r"\[code\](.*?)\[/code\]", "$1"),
    ("noparse", r"\[noparse\](.*?)\[/noparse\]", "$1"),
    ("table", r"\[table\].*?\[/table\]", " "),
    ("emoticon", r"\[emoticon\].*?\[/emoticon\]", " "),
)

FLAGS = "(?is)"
# Whitespace including the Unicode separators, spelled out so that every regex
# engine agrees on it.
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def collapse_space(text: Column) -> Column:
    """Every run of whitespace becomes one space; the ends are trimmed."""
    return F.btrim(F.regexp_replace(text, SPACE + "+", " "))


def apply_rule(text: Column, name: str, keep_content: bool = True) -> Column:
    """One markup rule on its own."""
    pattern, replacement = {n: (p, r) for n, p, r in MARKUP_RULES}[name]
    if keep_content and name == "list_item":
        # Deleting the bullet is the same as keeping the item text, without lookahead.
        return F.replace(text, F.lit("[*]"), F.lit(""))
    return F.regexp_replace(text, FLAGS + pattern, replacement if keep_content else "")


def clean_markup(text: Column, keep_content: bool = True) -> Column:
    """Clean one text: all rules in order, then whitespace.  Null becomes ''.

    A text goes through all rules at once, in Arrow batches: one expression for each rule
    would decode, search and encode the whole text eighteen times.
    """

    @F.arrow_udf("string")
    def cleaned(texts: pa.Array) -> pa.Array:
        # bytes that are no UTF-8 are replaced, as regular expressions of Spark do
        raw = (x.as_py() for x in texts.cast(pa.binary()))
        return pa.array((clean_text(x.decode("utf-8", "replace"), keep_content) if x else "" for x in raw), pa.string())

    return cleaned(text)


@cache
def _gaps(pattern: str) -> list[re.Pattern]:
    """What a pattern holds between its lazy gaps; letters are ASCII in either case."""
    return [re.compile(part, re.IGNORECASE | re.ASCII) for part in re.split(r"\(\.\*\?\)|\.\*\?", pattern)]


def replace_marks(text: str, pattern: str, replacement: str) -> str:
    """All matches of a rule replaced, by searching for one part after the other.

    After a lazy gap comes the next place of the part that follows.  Where a part is not
    found, no later start matches either, so the search is over.
    """
    parts, found, at = _gaps(pattern), [], 0
    while (first := parts[0].search(text, at)) is not None:
        last = first
        for part in parts[1:]:
            before, last = last, part.search(text, last.end())
            if last is None:
                return "".join([*found, text[at:]]) if found else text
        found += (text[at : first.start()], text[before.end() : last.start()] if replacement == "$1" else replacement)
        at = last.end()
    return "".join([*found, text[at:]]) if found else text


def clean_text(text: str, keep_content: bool = True) -> str:
    """All rules in order; runs of whitespace become one space, the ends are trimmed."""
    if "[" in text:
        for name, pattern, replacement in MARKUP_RULES:
            if keep_content and name == "list_item":
                text = text.replace("[*]", "")
            else:
                text = replace_marks(text, pattern, replacement if keep_content else "")
    # the whitespace of str.split is that of SPACE
    return " ".join(text.split())


def clean_reviews(df: DataFrame, fields=("review", "text"), keep_content: bool = True, out: str = "cleaned") -> DataFrame:
    """Clean the first field of ``fields`` that is present and not null."""
    present = [F.col(f) for f in fields if f in df.columns]
    source = F.coalesce(*present, F.lit("")) if present else F.lit("")
    return df.withColumn(out, clean_markup(source.cast("string"), keep_content))


def markup_usage(df: DataFrame, text: str = "review") -> DataFrame:
    """Matches of every rule on the raw text, one row per rule, in one pass."""
    tagged = df.select(F.col(text).alias("t")).filter(F.contains("t", F.lit("[")))
    counts = [
        F.coalesce(F.sum(_matches(F.col("t"), name, pattern)), F.lit(0)).cast("long").alias(name)
        for name, pattern, _ in MARKUP_RULES
    ]
    wide = tagged.agg(*counts)
    return wide.unpivot([], [F.col(n) for n, _, _ in MARKUP_RULES], "tag", "n")


def _matches(text: Column, name: str, pattern: str) -> Column:
    if name == "list_item":
        bare = F.replace(text, F.lit("[*]"), F.lit(""))
        return (F.length(text) - F.length(bare)) / F.lit(3)
    return F.regexp_count(text, F.lit(FLAGS + pattern))
