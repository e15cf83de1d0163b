"""Topic-term frames (topic, term, weight): ranking, scaling, export tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from reviewlens import settings
from reviewlens.scale import join_lookup


def top_words(topic_terms: DataFrame, n: int = settings.TOP_WORDS, absolute: bool = False) -> DataFrame:
    """The n strongest terms per topic with their rank; ties go by term.

    The rank limit reaches the map side, so a topic is cut to n rows per task
    before it is shuffled.
    """
    strength = F.abs("weight") if absolute else F.col("weight")
    w = Window.partitionBy("topic").orderBy(F.desc(strength), "term")
    return topic_terms.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def topic_details(ranked: DataFrame, keep_outlier: bool = False) -> DataFrame:
    """(topic_id, words[], scores[]) from ranked words; at most n entries each."""
    rows = ranked if keep_outlier else ranked.filter(F.col("topic").cast("string") != str(settings.OUTLIER_TOPIC))
    packed = rows.groupBy(F.col("topic").alias("topic_id")).agg(
        F.sort_array(F.collect_list(F.struct("rank", "term", "weight"))).alias("_w")
    )
    return packed.select(
        "topic_id",
        F.transform("_w", lambda s: s["term"]).alias("words"),
        F.transform("_w", lambda s: s["weight"]).alias("scores"),
    )


def l1_normalised(topic_terms: DataFrame) -> DataFrame:
    """Each topic's weights divided by their sum."""
    totals = topic_terms.groupBy("topic").agg(F.sum("weight").alias("_total"))
    return join_lookup(topic_terms, totals, "topic", ["term"], "inner").withColumn("weight", F.col("weight") / F.col("_total")).drop("_total")


def scaled_to_top(topic_terms: DataFrame) -> DataFrame:
    """Each topic's weights divided by its largest weight."""
    peaks = topic_terms.groupBy("topic").agg(F.max("weight").alias("_peak"))
    return join_lookup(topic_terms, peaks, "topic", ["term"], "inner").withColumn("scaled", F.col("weight") / F.col("_peak")).drop("_peak")


def topic_labels(details: DataFrame, n: int = settings.LABEL_WORDS) -> DataFrame:
    """Label of a topic: its first n words joined by ' + '."""
    return details.withColumn("label", F.array_join(F.slice("words", 1, n), " + "))


def importance(topic_terms: DataFrame) -> DataFrame:
    """Sum of a topic's weights."""
    return topic_terms.groupBy("topic").agg(F.sum("weight").alias("importance"))


def ordered_topics(topic_importance: DataFrame) -> DataFrame:
    """Topics by importance, most important first (one row per topic)."""
    w = Window.orderBy(F.desc("importance"), "topic")
    return topic_importance.withColumn("position", F.row_number().over(w))


def report_rows(topic_terms: DataFrame, topic_importance: DataFrame, n: int = settings.REPORT_WORDS) -> DataFrame:
    """Report table: topics by importance, n terms each."""
    ranked = top_words(topic_terms, n)
    return ranked.join(ordered_topics(topic_importance), "topic").select(
        "position", "topic", "importance", "rank", "term", "weight"
    )
