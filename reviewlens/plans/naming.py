"""Name the topics of an exported topic-word file."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from reviewlens.operators.naming import name_topics
from reviewlens.sources import results, review_files


def name_exported(spark: SparkSession, path: str, target: str, namer: Callable | None = None) -> DataFrame:
    rows = review_files.read_topic_words(spark, path)
    details = rows.withColumn("words", F.from_json("words", "array<string>"))
    named = name_topics(details, namer)
    results.write_named_topics(named, target)
    return named
