"""Statistics, profiles, filters, samples and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlens import settings
from reviewlens.catalog.registry import query, table
from reviewlens.functions import formatting
from reviewlens.operators import profile, sampling
from reviewlens.scale import row_hash, union_all

REVIEWS_SQL = """
reviews AS (
  SELECT d.doc_id AS review_id, d.source AS app_id, d.text AS review, d.lang, d.n_chars,
         l.quality AS review_score
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
"""


def reviews(spark, sf):
    """Documents in the role of reviews, labels in the role of scores."""
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("review_id"), F.col("source").alias("app_id"), F.col("text").alias("review"), "lang", "n_chars"
    )
    scores = table(spark, sf, "labels").select(F.col("doc_id").alias("review_id"), F.col("quality").alias("review_score"))
    return docs.join(scores, "review_id", "left")


@query(f"""
WITH {REVIEWS_SQL}
SELECT count(DISTINCT app_id) AS game_count, count(*) AS review_count,
       count(*) FILTER (WHERE review_score > 0) AS positive_reviews,
       count(*) FILTER (WHERE review_score <= 0) AS negative_reviews,
       round(100.0 * count(*) FILTER (WHERE review_score > 0) / count(*), 6) AS positive_percentage
FROM reviews""")
def dataset_stats(spark, sf):
    stats = profile.dataset_stats(reviews(spark, sf), digits=None)
    return stats.withColumn("positive_percentage", F.round("positive_percentage", 6))


@query("""
SELECT 0::BIGINT AS game_count, count(*) AS review_count, 0::BIGINT AS positive_reviews,
       0::BIGINT AS negative_reviews, 0.0::DOUBLE AS positive_percentage FROM documents""")
def dataset_stats_missing_columns(spark, sf):
    return profile.dataset_stats(table(spark, sf, "documents"))


@query("SELECT count(DISTINCT source) AS games FROM documents")
def distinct_games(spark, sf):
    return table(spark, sf, "documents").agg(F.countDistinct("source").alias("games"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def reviews_per_game(spark, sf):
    return profile.reviews_per_game(table(spark, sf, "documents"), "source")


@query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 10")
def top_games(spark, sf):
    return profile.top_games(table(spark, sf, "documents"), "source")


@query("SELECT doc_id, source, count(*) OVER (PARTITION BY source) AS reviews_per_game FROM documents")
def count_back_on_row(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return profile.count_back_on_row(docs, "source", "doc_id")


@query("SELECT DISTINCT source, count(*) OVER (PARTITION BY source) AS reviews_per_game FROM documents")
def distinct_game_counts(spark, sf):
    return profile.distinct_game_counts(table(spark, sf, "documents"), "source")


@query(f"""
WITH {REVIEWS_SQL},
c AS (SELECT count(*) AS n, count(review_id) AS a, count(app_id) AS b, count(review) AS d,
             count(lang) AS e, count(n_chars) AS f, count(review_score) AS g FROM reviews)
SELECT 'review_id' AS "column", n - a AS nulls FROM c UNION ALL
SELECT 'app_id', n - b FROM c UNION ALL SELECT 'review', n - d FROM c UNION ALL
SELECT 'lang', n - e FROM c UNION ALL SELECT 'n_chars', n - f FROM c UNION ALL
SELECT 'review_score', n - g FROM c""")
def null_profile(spark, sf):
    return profile.null_profile(reviews(spark, sf))


def _summary_sql(tbl, col):
    return f"""
SELECT '{col}' AS "column", count({col}) AS "count", round(avg({col}), 6) AS mean,
       round(stddev_samp({col}), 6) AS std, min({col})::DOUBLE AS min,
       quantile_cont({col}::DOUBLE, 0.25) AS p25, quantile_cont({col}::DOUBLE, 0.5) AS p50,
       quantile_cont({col}::DOUBLE, 0.75) AS p75, max({col})::DOUBLE AS max FROM {tbl}"""


@query(" UNION ALL ".join(_summary_sql("events", c) for c in ("event_id", "user_id", "value")))
def numeric_profile(spark, sf):
    summary = profile.numeric_profile(table(spark, sf, "events"))
    return summary.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query('SELECT count(*) AS "rows", 5::BIGINT AS "columns" FROM documents')
def table_shape(spark, sf):
    return profile.shape(table(spark, sf, "documents"))


@query("""
SELECT user_id AS appid,
       count(*) FILTER (WHERE event_type = 'view') AS "view",
       count(*) FILTER (WHERE event_type = 'purchase') AS purchase
FROM events GROUP BY user_id""")
def download_progress(spark, sf):
    events = table(spark, sf, "events").withColumnRenamed("user_id", "appid")
    return profile.download_progress(events, "appid", "event_type", ["view", "purchase"])


# --- projections and filters ------------------------------------------------


@query(f"WITH {REVIEWS_SQL} SELECT review_id, review_score FROM reviews WHERE review_score IS NOT NULL")
def drop_null_reviews(spark, sf):
    return reviews(spark, sf).dropna(subset=["review_score"]).select("review_id", "review_score")


@query(f"WITH {REVIEWS_SQL} SELECT review_id, CAST(n_chars AS VARCHAR) AS n_chars FROM reviews")
def cast_to_string(spark, sf):
    return reviews(spark, sf).select("review_id", F.col("n_chars").cast("string").alias("n_chars"))


@query("""
SELECT d.doc_id, coalesce(CASE WHEN l.quality = 1 THEN d.text END, d.lang, '') AS field,
       coalesce(CASE WHEN l.quality = 1 THEN d.text END, '') AS guarded
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def field_fallback(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    review = F.when(F.col("quality") == 1, F.col("text"))
    return docs.select(
        "doc_id", F.coalesce(review, "lang", F.lit("")).alias("field"), F.coalesce(review, F.lit("")).alias("guarded")
    )


@query("SELECT doc_id, lang FROM documents")
def drop_columns(spark, sf):
    return profile.without_identifiers(table(spark, sf, "documents"), ("text", "source", "n_chars"))


@query("SELECT source, doc_id FROM documents")
def column_subset(spark, sf):
    return table(spark, sf, "documents").select("source", "doc_id")


@query("SELECT label AS topic, CAST(CAST(label AS VARCHAR) AS INTEGER) AS topic_number, count(*) AS n FROM embeddings GROUP BY label")
def numeric_topic_id(spark, sf):
    text_ids = table(spark, sf, "embeddings").groupBy(F.col("label").alias("topic")).agg(F.count(F.lit(1)).alias("n"))
    return text_ids.select("topic", F.col("topic").cast("string").cast("int").alias("topic_number"), "n")


@query(f"""
WITH {REVIEWS_SQL}
SELECT count(*) FILTER (WHERE review_score > 0) AS positive,
       count(*) FILTER (WHERE review_score <= 0) AS negative,
       count(*) FILTER (WHERE review_score IS NULL) AS neither FROM reviews""")
def polarity_predicates(spark, sf):
    score = F.col("review_score")
    return reviews(spark, sf).agg(
        F.count_if(formatting.is_positive(score)).alias("positive"),
        F.count_if(formatting.is_negative(score)).alias("negative"),
        F.count_if(score.isNull()).alias("neither"),
    )


@query("""
SELECT label - 1 AS topic, count(*) AS n FROM embeddings WHERE label - 1 <> -1 GROUP BY label""")
def outlier_filter(spark, sf):
    topics = table(spark, sf, "embeddings").select((F.col("label") - 1).alias("topic"))
    return topics.filter(F.col("topic") != settings.OUTLIER_TOPIC).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT event_id, CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 END AS sentiment_value FROM events""")
def label_to_value(spark, sf):
    label = F.when(F.col("event_type") == "purchase", "POSITIVE").when(F.col("event_type") == "error", "NEGATIVE")
    return table(spark, sf, "events").select("event_id", formatting.sentiment_value(label).alias("sentiment_value"))


# --- samples ------------------------------------------------------------------


@query(f"""
SELECT doc_id, source FROM documents
ORDER BY md5(concat_ws('|', CAST(doc_id AS VARCHAR), '{settings.SEED}')), doc_id LIMIT 300""")
def sample_exact_n(spark, sf):
    return sampling.exact_sample(table(spark, sf, "documents").select("doc_id", "source"), 300, ["doc_id"])


@query(f"""
SELECT event_id FROM events
ORDER BY md5(concat_ws('|', CAST(event_id AS VARCHAR), '{settings.SEED}')), event_id LIMIT {settings.DOCUMENT_MAP_SAMPLE}""")
def sample_map_cap(spark, sf):
    return sampling.exact_sample(table(spark, sf, "events").select("event_id"), settings.DOCUMENT_MAP_SAMPLE, ["event_id"])


@query(f"""
SELECT doc_id FROM documents
WHERE md5(concat_ws('|', CAST(doc_id AS VARCHAR), '3')) < '{sampling.hex_share(settings.STABILITY_SHARE)}'""")
def sample_share(spark, sf):
    return sampling.share_sample(table(spark, sf, "documents").select("doc_id"), settings.STABILITY_SHARE, ["doc_id"], 3)


@query(f"SELECT doc_id, source, n_chars FROM documents ORDER BY doc_id LIMIT {settings.EXTRACT_ROWS}")
def first_rows(spark, sf):
    return sampling.first_rows(table(spark, sf, "documents").select("doc_id", "source", "n_chars"), ["doc_id"])


# --- unions -------------------------------------------------------------------


@query("""
SELECT doc_id AS id, text, lang FROM documents UNION ALL
SELECT item_id, text, NULL FROM benchmark UNION ALL SELECT conv_id, text, NULL FROM conversations""")
def union_by_name(spark, sf):
    return union_all([
        table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "lang"),
        table(spark, sf, "benchmark").select("text", F.col("item_id").alias("id")),
        table(spark, sf, "conversations").select(F.col("conv_id").alias("id"), "text"),
    ])


@query("""
SELECT event_id, user_id, 'positive' AS review_type FROM events WHERE event_type = 'purchase' UNION ALL
SELECT event_id, user_id, 'negative' FROM events WHERE event_type = 'error'""")
def union_of_fetches(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return union_all([
        events.filter(F.col("event_type") == kind).drop("event_type").withColumn("review_type", F.lit(name))
        for kind, name in (("purchase", "positive"), ("error", "negative"))
    ])


# --- small functions ------------------------------------------------------------


@query("""
SELECT substr(md5(string_agg(text, '|' ORDER BY doc_id) || '|' || (SELECT count(*) FROM documents)), 1, 10) AS fingerprint
FROM (SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 3)""")
def fingerprint(spark, sf):
    return formatting.fingerprint(table(spark, sf, "documents"), "text", "doc_id")


@query("""
SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp, strftime(ts, '%Y-%m-%d %H:%M:%S') AS file_time,
       strftime(strptime(strftime(ts, '%Y%m%d_%H%M%S'), '%Y%m%d_%H%M%S'), '%Y-%m-%d %H:%M:%S') AS parsed
FROM events""")
def stamps(spark, sf):
    ts = F.col("ts")
    stamp = formatting.run_stamp(ts)
    return table(spark, sf, "events").select(
        "event_id", stamp.alias("stamp"), formatting.file_time(ts).alias("file_time"),
        formatting.file_time(formatting.parse_stamp(stamp)).alias("parsed"),
    )


@query("""
SELECT event_id, strftime(to_timestamp(1700000000 + event_id) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS created FROM events""")
def unix_seconds(spark, sf):
    created = formatting.unix_seconds(F.lit(1700000000) + F.col("event_id"))
    utc = F.to_utc_timestamp(created, F.current_timezone())
    return table(spark, sf, "events").select("event_id", formatting.file_time(utc).alias("created"))


@query("""
SELECT event_type, round(avg(value), 6) AS mean_value, round(stddev_samp(value), 6) AS std_value
FROM events GROUP BY event_type""")
def rounding(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(
        F.bround(F.avg("value"), 6).alias("mean_value"), F.bround(F.stddev_samp("value"), 6).alias("std_value")
    )


@query("SELECT page_id, replace(url_encode(url || ' ~*'), '%2F', '/') AS cursor FROM pages")
def encode_cursor(spark, sf):
    cursor = formatting.quote_cursor(F.concat("url", F.lit(" ~*")))
    return table(spark, sf, "pages").select("page_id", cursor.alias("cursor"))
