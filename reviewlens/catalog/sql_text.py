"""Checking-SQL counterparts of the text functions."""

from __future__ import annotations

from reviewlens import settings
from reviewlens.catalog.registry import sql_list
from reviewlens.functions import markup, text


def clean(expr: str, keep_content: bool = True) -> str:
    for name, pattern, replacement in markup.MARKUP_RULES:
        if name == "list_item":
            expr = f"replace({expr}, '[*]', '')"
            continue
        target = replacement.replace("$1", r"\1") if keep_content else ""
        expr = f"regexp_replace({expr}, '{markup.FLAGS}{pattern}', '{target}', 'g')"
    return f"trim(regexp_replace({expr}, '{markup.SPACE}+', ' ', 'g'))"


def collapse(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '{markup.SPACE}+', ' ', 'g'))"


def sentences(source: str, expr: str, keys: str) -> str:
    """SELECT of (keys, sent_pos, sentence) from a relation."""
    marked = rf"string_split(regexp_replace({expr}, '{text.SENTENCE_END}', '\1' || chr(10), 'g'), chr(10))"
    return f"""
SELECT {keys}, sent_pos - 1 AS sent_pos, sentence FROM (
  SELECT {keys}, unnest(parts) AS sentence, generate_subscripts(parts, 1) AS sent_pos
  FROM (SELECT {keys}, {marked} AS parts FROM {source}))
WHERE trim(sentence) <> ''"""


def unicode_norm(expr: str) -> str:
    return rf"regexp_replace(lower({expr}), '{text.NOT_WORD}', ' ', 'g')"


def ascii_norm(expr: str) -> str:
    return rf"regexp_replace(regexp_replace(lower({expr}), '{text.URL}', '', 'g'), '{text.NOT_ASCII_LETTER}', '', 'g')"


def words(expr: str) -> str:
    return rf"list_filter(string_split_regex({expr}, '{text.BLANK_RUN}'), lambda w: w <> '')"


def lemma(word: str) -> str:
    cases = " ".join(
        f"WHEN ends_with({word}, '{e}') THEN left({word}, length({word}) - {len(e)}) || '{r}'" for e, r in text.LEMMA_ENDINGS
    )
    return f"CASE {cases} ELSE {word} END"


def tokens(normalized: str, stop_words) -> str:
    kept = f"list_filter({words(normalized)}, lambda w: length(w) >= {settings.MIN_TOKEN_LENGTH} AND w NOT IN ({sql_list(stop_words)}))"
    return f"list_transform({kept}, lambda w: {lemma('w')})"


def study_docs(relation: str = "documents") -> str:
    """CTEs ending in study(doc_id, sent_pos, tokens): sentence documents."""
    return f"""
lowered AS (SELECT doc_id, lower(text) AS text FROM {relation} WHERE text IS NOT NULL),
sents AS ({sentences('lowered', 'text', 'doc_id')}),
study AS (
  SELECT * FROM (SELECT doc_id, sent_pos, {tokens(unicode_norm('sentence'), settings.STUDY_STOP_WORDS)} AS tokens FROM sents)
  WHERE len(tokens) > 0)"""


def fixed_docs(relation: str = "documents") -> str:
    """CTE fixed(doc_id, tokens): one token list per review."""
    return f"""
fixed AS (
  SELECT * FROM (SELECT doc_id, {tokens(ascii_norm('text'), settings.FIXED_STOP_WORDS)} AS tokens FROM {relation})
  WHERE len(tokens) > 0)"""
