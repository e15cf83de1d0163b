"""Incremental ingest of landed feed pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from reviewlens.functions.formatting import run_stamp
from reviewlens.sources import schemas
from reviewlens.sources.feed import flatten_pages, write_reviews


def page_stream(
    spark: SparkSession, landing: str, files_per_trigger: int = 1000, max_file_age: str = "36500d"
) -> DataFrame:
    """Landed pages.

    A file counts as new whatever its modification time, as files restored from a copy
    have old ones: the source would pass over those older than ``max_file_age``, seen
    from the newest file.
    """
    reader = spark.readStream.schema(schemas.FEED_PAGE)
    return reader.option("maxFilesPerTrigger", files_per_trigger).option("maxFileAge", max_file_age).json(landing)


def page_reviews(pages: DataFrame) -> DataFrame:
    """Reviews of successful pages."""
    rows = flatten_pages(pages.filter(F.coalesce("success", F.lit(0)) != 0)).drop("page_no", "pos")
    return rows.withColumn("ts", F.timestamp_seconds("timestamp_created"))


def start_ingest(spark: SparkSession, landing: str, target: str, checkpoint: str, once: bool = True):
    """Merge new reviews by id into the table of games and types; ``once`` drains what has landed.

    Each batch replaces the partitions it touches, so a batch that is repeated after a
    failure changes nothing, and no state is kept beyond the table.
    """

    def merge(batch: DataFrame, _: int) -> None:
        write_reviews(batch.withColumn("fetch_date", run_stamp()), target)

    writer = page_reviews(page_stream(spark, landing)).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()
