"""Ingest: landed feed pages and review files to one review table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from reviewlens.operators.profile import download_progress
from reviewlens.sources import feed, review_files


def ingest_feed(
    spark: SparkSession, landing: str, target: str, catalogue: str | None = None, cap: int | None = None
) -> DataFrame:
    """Write the reviews of all landed pages; returns progress per game.

    With a catalogue only its games are ingested.
    """
    pages = feed.read_pages(spark, landing)
    if catalogue:
        games = review_files.read_catalogue(spark, catalogue).select(F.col("AppID").alias("appid"))
        pages = pages.join(games, "appid", "left_semi")
    feed.write_reviews(feed.feed_reviews(pages, cap), target)
    return download_progress(spark.read.parquet(target), "appid", "review_type", ["positive", "negative"])


def combine_files(spark: SparkSession, pattern: str, target: str) -> DataFrame:
    """Union of review files, written once as Parquet so later scans can split."""
    review_files.read_reviews(spark, pattern).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)
