"""Sentence splitting, normalisation and tokens as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reviewlens import settings
from reviewlens.functions.markup import clean_markup
from reviewlens.scale import join_lookup

# Patterns of the text steps.
SENTENCE_END = r"([.!?]+)\s+"
NOT_WORD = r"http\S+|www\S+|[^\p{L}\p{N}_\s]"
URL = r"http\S+|www\S+"
NOT_ASCII_LETTER = r"[^a-z\s]"
BLANK_RUN = r"\s+"
NOT_BLANK = r"[^\s\p{Z}\x1C-\x1F\x85]"

# Noun endings and their replacements, longest first.
LEMMA_ENDINGS = (
    ("ches", "ch"), ("shes", "sh"), ("ies", "y"), ("ses", "s"), ("ves", "f"),
    ("xes", "x"), ("zes", "z"), ("men", "man"), ("ss", "ss"), ("s", ""),
)


def mark_sentences(text: Column) -> Column:
    """Put a newline after every sentence end."""
    return F.regexp_replace(text, SENTENCE_END, "$1\n")


def sentence_array(text: Column) -> Column:
    return F.split(mark_sentences(text), "\n")


def explode_sentences(df: DataFrame, text: str, keys: list[str], lower: bool = False) -> DataFrame:
    """One row per non-blank sentence, keyed by ``keys`` and its position."""
    source = F.lower(F.col(text)) if lower else F.col(text)
    exploded = df.select(*keys, F.posexplode(sentence_array(source)).alias("sent_pos", "sentence"))
    return exploded.filter(F.col("sentence").rlike(NOT_BLANK))


def normalize_unicode(text: Column) -> Column:
    """Lower-case; URLs and everything but letters, digits, '_' become spaces."""
    return F.regexp_replace(F.lower(text), NOT_WORD, " ")


def normalize_ascii(text: Column) -> Column:
    """Lower-case; URLs and everything but a-z and whitespace are deleted."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), URL, ""), NOT_ASCII_LETTER, "")


def words(text: Column) -> Column:
    """Split on whitespace; null and blank give an empty array."""
    parts = F.split(F.coalesce(text, F.lit("")), BLANK_RUN)
    return F.filter(parts, lambda w: w != "")


def keep_word(word: Column, stop_words: list[str], min_length: int = settings.MIN_TOKEN_LENGTH) -> Column:
    return (F.length(word) >= min_length) & ~word.isin(*stop_words)


def lemma(word: Column) -> Column:
    """Singular form by noun endings (no dictionary)."""
    # Most words have none of the endings: settle those with two comparisons.
    plain = ~F.endswith(word, F.lit("s")) & ~F.endswith(word, F.lit("men"))
    expr = F.when(plain, word)
    for ending, repl in LEMMA_ENDINGS:
        hit = F.endswith(word, F.lit(ending))
        stem = F.concat(F.substring(word, F.lit(1), F.length(word) - len(ending)), F.lit(repl))
        expr = expr.when(hit, stem)
    return expr.otherwise(word)


def lemmatize_by_table(df: DataFrame, word: str, lemmas: DataFrame, salt_by: list[str]) -> DataFrame:
    """Lemma from a (word, lemma) table, falling back to the ending rules."""
    table = lemmas.select(F.col("word").alias(word), F.col("lemma").alias("_lemma"))
    joined = join_lookup(df, table, word, salt_by)
    return joined.withColumn("lemma", F.coalesce("_lemma", lemma(F.col(word)))).drop("_lemma")


def tokens(
    normalized: Column, stop_words: list[str], lemmatize: bool = True, min_length: int = settings.MIN_TOKEN_LENGTH
) -> Column:
    """Words, minus stop words and short ones, then lemmas."""
    kept = F.filter(words(normalized), lambda w: keep_word(w, stop_words, min_length))
    return F.transform(kept, lemma) if lemmatize else kept


def ngrams(tokens_col: Column, low: int = 1, high: int = 2) -> Column:
    """All word n-grams of sizes low..high, shorter ones first."""
    parts = []
    for n in range(low, high + 1):
        if n == 1:
            parts.append(tokens_col)
            continue
        starts = F.sequence(F.lit(1), F.size(tokens_col) - (n - 1))
        grams = F.transform(starts, lambda i: F.array_join(F.slice(tokens_col, i, n), " "))
        parts.append(F.when(F.size(tokens_col) >= n, grams).otherwise(F.array().cast("array<string>")))
    return F.concat(*parts)


# --- frame-level preprocessing --------------------------------------------


def evaluated_once(df: DataFrame, keys: list[str], expr: Column, name: str) -> DataFrame:
    """Keys and one costly expression, as a one-element explode.

    Filters on the result stay above it.  On a plain projection the optimizer
    pushes them down and evaluates the whole expression a second time there.
    """
    return df.select(*keys, F.explode(F.array(expr)).alias(name))


def review_sentences(df: DataFrame, text: str, keys: list[str], markup: bool = True) -> DataFrame:
    """Null reviews dropped, optionally cleaned of markup, split into sentences."""
    kept = df.select(*keys, F.col(text).cast("string").alias("_text")).dropna(subset=["_text"])
    if markup:
        kept = kept.withColumn("_text", clean_markup(F.col("_text")))
    return explode_sentences(kept, "_text", keys)


def study_sentences(df: DataFrame, text: str, keys: list[str], stop_words=None, lemmatize: bool = True) -> DataFrame:
    """Sentence documents of the sentence study: lower-cased, normalised tokens.

    Sentences without any token left are dropped.
    """
    stop_words = settings.STUDY_STOP_WORDS if stop_words is None else stop_words
    sentences = explode_sentences(df.dropna(subset=[text]), text, keys, lower=True)
    words_kept = tokens(normalize_unicode(F.col("sentence")), stop_words, lemmatize)
    tokenised = evaluated_once(sentences, [*keys, "sent_pos"], words_kept, "tokens")
    return tokenised.filter(F.size("tokens") > 0).withColumn("processed", F.array_join("tokens", " "))


def fixed_tokens(df: DataFrame, text: str, keys: list[str], stop_words=None) -> DataFrame:
    """One token list per review for the fixed-count study; empty lists dropped."""
    stop_words = settings.FIXED_STOP_WORDS if stop_words is None else stop_words
    kept = df.select(*keys, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    tokenised = evaluated_once(kept, keys, tokens(normalize_ascii(F.col("_text")), stop_words), "tokens")
    return tokenised.filter(F.size("tokens") > 0)
