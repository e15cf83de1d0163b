"""Class-based TF-IDF: words that set one topic apart from the others."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from reviewlens import settings
from reviewlens.functions.text import ngrams
from reviewlens.scale import join_lookup


def class_term_counts(tokens_df: DataFrame, topic: str, tokens: str = "tokens", sizes=(1, 1)) -> DataFrame:
    """(topic, term, tf) over all documents of a topic; pre-aggregated per task."""
    grams = F.col(tokens) if sizes == (1, 1) else ngrams(F.col(tokens), *sizes)
    return (
        tokens_df.select(F.col(topic).alias("topic"), F.explode(grams).alias("term"))
        .groupBy("topic", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def limit_by_topics(counts: DataFrame, min_df: int = settings.TOPIC_MIN_DF, max_df: float = settings.TOPIC_MAX_DF) -> DataFrame:
    """Terms found in at least min_df topics and at most a share max_df of them.

    The counts are persisted, so that their shuffle happens once; a second one brings the
    topics of a term together, of which each is one row.
    """
    counts = counts.persist()
    topics = counts.agg(F.countDistinct("topic").alias("n")).scalar()
    spread = counts.filter(F.col("term").isNotNull()).withColumn("_topics", F.count(F.lit(1)).over(Window.partitionBy("term")))
    return spread.filter((F.col("_topics") >= min_df) & (F.col("_topics") <= max_df * topics)).drop("_topics")


def class_tfidf(counts: DataFrame) -> DataFrame:
    """Weight tf/words(topic) * ln(1 + A/f(term)).

    A is the mean number of words per topic, cut to a whole number; f is the
    term's frequency over all topics.  A term has at most one row per topic
    here, so joining on the term cannot be skewed; the topic sizes are joined
    with a size check.  The counts are persisted: they are read three times, the
    texts behind them once.
    """
    counts = counts.persist()
    sizes = counts.groupBy("topic").agg(F.sum("tf").alias("topic_words"))
    mean_words = sizes.agg(F.floor(F.avg("topic_words")).alias("a")).scalar()
    frequency = counts.groupBy("term").agg(F.sum("tf").alias("f"))
    idf = frequency.select("term", F.log(1 + mean_words / F.col("f")).alias("idf"))
    weighted = counts.join(idf, "term")
    sized = join_lookup(weighted, sizes, "topic", salt_by=["term"], how="inner")
    return sized.select("topic", "term", (F.col("tf") / F.col("topic_words") * F.col("idf")).alias("weight"))
