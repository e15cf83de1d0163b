"""Result tables, run summaries, stage checkpoints.

All locations are URIs handed to Spark's writers, so the same call writes to a
local folder, a shared file system or an object store.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from reviewlens import settings
from reviewlens.sources import schemas
from reviewlens.sources.review_files import CSV_OPTIONS

# Names of the artefacts of one analysis.
ARTEFACTS = ("topic_info", "topic_details", "document_topics", "sentiment_analysis")
#: Further tables that are saved and loaded where an analysis has them.
MORE_TABLES = ("topic_names", "markup_usage", "topic_vectors", "topic_terms")


def new_stamp() -> str:
    return datetime.now().strftime("%Y%m%d_%H%M%S")


def _read_or_none(reader):
    try:
        return reader()
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return None
        raise


# --- analyses ----------------------------------------------------------------


def run_summary(tables: dict[str, DataFrame], stamp: str) -> DataFrame:
    """One row: time, counts and the sentiment table (one entry per topic)."""
    sentences = tables["document_topics"].agg(F.count(F.lit(1)).alias("n")).scalar()
    topics = tables["topic_info"].agg(F.count(F.lit(1)).alias("n")).scalar()
    fields = schemas.RUN_SUMMARY["sentiment_analysis"].dataType.elementType.names
    packed = tables["sentiment_analysis"].agg(
        F.sort_array(F.collect_list(F.struct(*fields))).alias("sentiment_analysis")
    )
    return packed.select(
        F.lit(stamp).alias("timestamp"), sentences.alias("num_sentences"), topics.alias("num_topics"), "sentiment_analysis"
    )


def save_analysis(tables: dict[str, DataFrame], base: str, stamp: str | None = None, csv: bool = False) -> str:
    """Write the tables of one analysis under ``run_id=<stamp>``; returns the id."""
    stamp = stamp or new_stamp()
    for name in (*ARTEFACTS, *MORE_TABLES):
        if name in tables:
            tables[name].write.mode("overwrite").parquet(f"{base}/{name}/run_id={stamp}")
            if csv:
                write_csv(tables[name], f"{base}/csv/{name}_{stamp}")
    run_summary(tables, stamp).write.mode("overwrite").json(f"{base}/summary/run_id={stamp}")
    return stamp


def load_analysis(spark: SparkSession, base: str, run_id: str) -> dict[str, DataFrame]:
    """All tables of one saved analysis by name, the summary included."""
    found = {}
    for name in (*ARTEFACTS, *MORE_TABLES):
        table = _read_or_none(lambda: spark.read.parquet(f"{base}/{name}/run_id={run_id}"))
        if table is not None:
            found[name] = table
    found["summary"] = spark.read.schema(schemas.RUN_SUMMARY).json(f"{base}/summary/run_id={run_id}")
    return found


def recent_runs(runs: DataFrame, order: str = "run_ts", topics: str = "topic_count", name: str = "run_id", n: int = settings.RECENT_RUNS) -> DataFrame:
    """Newest n runs with their topic count, 'Unknown' where it is missing."""
    newest = runs.orderBy(F.desc(order), name).limit(n)
    return newest.select(
        name, F.date_format(order, "yyyy-MM-dd HH:mm:ss").alias("date"),
        F.coalesce(F.col(topics).cast("string"), F.lit("Unknown")).alias("topic_count"),
    )


def recent_analyses(spark: SparkSession, base: str, n: int = settings.RECENT_RUNS) -> DataFrame:
    summaries = spark.read.schema(schemas.RUN_SUMMARY).json(f"{base}/summary")
    runs = summaries.select(
        F.col("timestamp").alias("run_id"), F.to_timestamp("timestamp", "yyyyMMdd_HHmmss").alias("run_ts"),
        F.size("sentiment_analysis").alias("_size"),
    ).withColumn("topic_count", F.when(F.col("_size") >= 0, F.col("_size")))
    return recent_runs(runs, n=n)


def copy_results(spark: SparkSession, base: str, run_id: str, target: str) -> None:
    """Write one analysis again under another URI."""
    for name, table in load_analysis(spark, base, run_id).items():
        writer = table.write.mode("overwrite")
        (writer.json if name == "summary" else writer.parquet)(f"{target}/{name}/run_id={run_id}")


# --- stage checkpoints ----------------------------------------------------------


def save_stage(df: DataFrame, base: str, stage: str, checkpoint_id: str, stamp: str | None = None) -> str:
    """Write a stage as Parquet and append its line to the checkpoint log."""
    stamp = stamp or new_stamp()
    path = f"{base}/{checkpoint_id}_{stage}_{stamp}"
    df.write.mode("overwrite").parquet(path)
    line = df.sparkSession.createDataFrame([Row(timestamp=stamp, stage=stage, filename=path)], schemas.CHECKPOINT_LOG)
    line.coalesce(1).write.mode("append").json(f"{base}/{checkpoint_id}_metadata")
    return path


def latest_by_stage(log: DataFrame) -> DataFrame:
    return log.groupBy("stage").agg(F.max_by("filename", "timestamp").alias("filename"))


def load_stage(spark: SparkSession, base: str, stage: str, checkpoint_id: str) -> tuple[DataFrame | None, bool]:
    """Latest saved frame of a stage, or (None, False)."""
    log = _read_or_none(lambda: spark.read.schema(schemas.CHECKPOINT_LOG).json(f"{base}/{checkpoint_id}_metadata"))
    if log is None:
        return None, False
    row = latest_by_stage(log.filter(F.col("stage") == stage)).head()
    if row is None:
        return None, False
    saved = _read_or_none(lambda: spark.read.parquet(row["filename"]))
    return saved, saved is not None


# --- small text and CSV outputs ---------------------------------------------------


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with arrays as JSON text."""
    texts = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in df.schema.fields]
    options = {k: v for k, v in CSV_OPTIONS.items() if k != "multiLine"}
    df.select(*texts).write.mode("overwrite").options(**options).csv(path)


def write_topic_words(details: DataFrame, base: str, method: str, k: int) -> str:
    """(topic_id, words, scores) as CSV; one row per topic, so one file."""
    path = f"{base}/{method}_{k}_topics"
    write_csv(details.select("topic_id", "words", "scores").coalesce(1), path)
    return path


def write_named_topics(named: DataFrame, path: str) -> None:
    write_csv(named.select("topic_id", "words", "topic_name").coalesce(1), path)


def report_lines(metrics: dict, report: DataFrame) -> DataFrame:
    """Text report: metrics, then topics by importance with their terms.

    The report has topics x 19 lines at most.
    """
    head = [
        "", f"Number of topics: {metrics['n_topics']}", f"Coherence: {metrics['coherence']:.4f}",
        f"Diversity: {metrics['diversity']:.4f}", f"Stability: {metrics['stability']:.4f}",
        f"Performance: {metrics['performance']:.4f}", f"Combined Score: {metrics['combined_score']:.4f}", "",
    ]
    spark = report.sparkSession
    top = spark.createDataFrame([(0, i, line) for i, line in enumerate(head)], "position int, rank int, value string")
    titles = report.select("position", "importance").distinct().select(
        "position", F.lit(0).alias("rank"), F.format_string("Topic %d (Importance: %.4f):", "position", "importance").alias("value")
    )
    words = report.select("position", "rank", F.format_string("  - %s: %.4f", "term", "weight").alias("value"))
    gaps = report.select("position").distinct().select("position", F.lit(1 << 30).alias("rank"), F.lit("").alias("value"))
    return top.unionByName(titles).unionByName(words).unionByName(gaps).orderBy("position", "rank")


def write_report(metrics: dict, report: DataFrame, path: str) -> None:
    report_lines(metrics, report).select("value").coalesce(1).write.mode("overwrite").text(path)


def plot_metadata(tables: dict[str, DataFrame], names: list[str], stamp: str | None = None) -> DataFrame:
    """What was prepared for plotting, from how many topics and documents."""
    topics = tables["topic_info"].agg(F.count(F.lit(1)).alias("n")).scalar()
    return tables["document_topics"].agg(F.count(F.lit(1)).alias("num_documents")).select(
        F.lit(stamp or new_stamp()).alias("timestamp"), F.array(*[F.lit(n) for n in names]).alias("visualizations"),
        topics.alias("num_topics"), "num_documents",
    )


def write_plot_metadata(tables: dict[str, DataFrame], names: list[str], base: str, stamp: str | None = None) -> None:
    plot_metadata(tables, names, stamp).write.mode("append").json(f"{base}/visualization_metadata")
