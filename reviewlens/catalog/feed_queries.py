"""Feed pages, stop rules, run lists, checkpoint logs."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from reviewlens.catalog.registry import query, table
from reviewlens.sources import feed, results, schemas

PAGE_SIZE = 4

# Events in the role of reviews: user = game, event type = review type.  Every
# four events of a request form a page; some pages fail, some end the feed.
PAGES_SQL = f"""
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS idx FROM events),
pages AS (
  SELECT user_id AS appid, event_type AS review_type, idx // {PAGE_SIZE} AS page_no,
         list(event_id ORDER BY event_id) AS ids,
         CASE WHEN sum(event_id) % 11 = 0 THEN 0 ELSE 1 END AS success,
         CASE WHEN sum(event_id) % 13 = 0 THEN '*' ELSE 'next' END AS cursor
  FROM numbered GROUP BY ALL),
ends AS (
  SELECT appid, review_type, min(page_no) FILTER (WHERE success = 0) AS broken,
         min(page_no) FILTER (WHERE cursor = '*') AS last_page
  FROM pages GROUP BY ALL),
kept AS (
  SELECT p.* FROM pages p JOIN ends USING (appid, review_type)
  WHERE (broken IS NULL OR page_no < broken) AND (last_page IS NULL OR page_no <= last_page)),
reviews_flat AS (
  SELECT appid, review_type, page_no, unnest(ids) AS recommendationid, generate_subscripts(ids, 1) - 1 AS pos FROM kept)"""


def feed_pages(spark, sf):
    """Feed pages built from the event table."""
    request = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    item_fields = {
        "recommendationid": F.col("event_id"), "review": F.col("props"), "weighted_vote_score": F.col("value"),
        "voted_up": F.col("value") > 10,
    }
    item = schemas.FEED_PAGE["reviews"].dataType.elementType
    cells = []
    for field in item.fields:
        if field.name == "author":
            author = [
                (F.col("user_id") if a.name == "steamid" else F.lit(None).cast(a.dataType)).alias(a.name)
                for a in field.dataType.fields
            ]
            cells.append(F.struct(*author).alias("author"))
        else:
            cells.append(item_fields.get(field.name, F.lit(None)).cast(field.dataType).alias(field.name))
    numbered = table(spark, sf, "events").withColumn("at", F.row_number().over(request) - 1)
    total = F.sum("event_id")
    return (
        numbered.groupBy("user_id", "event_type", F.floor(F.col("at") / PAGE_SIZE).alias("page_no"))
        .agg(
            F.when(total % 11 == 0, 0).otherwise(1).alias("success"),
            F.when(total % 13 == 0, "*").otherwise("next").alias("cursor"),
            F.sort_array(F.collect_list(F.struct(*cells))).alias("reviews"),
        )
        .withColumnsRenamed({"user_id": "appid", "event_type": "review_type"})
    )


@query(f"WITH {PAGES_SQL} SELECT appid, review_type, page_no FROM kept")
def feed_stop_rules(spark, sf):
    return feed.followed_pages(feed_pages(spark, sf)).select("appid", "review_type", "page_no")


@query(f"WITH {PAGES_SQL} SELECT appid, review_type, page_no, pos::INTEGER AS pos, recommendationid, appid AS author_steamid FROM reviews_flat")
def feed_flatten(spark, sf):
    rows = feed.flatten_pages(feed.followed_pages(feed_pages(spark, sf)))
    return rows.select("appid", "review_type", "page_no", "pos", "recommendationid", "author_steamid")


@query(f"""
WITH {PAGES_SQL}, capped AS (
  SELECT *, row_number() OVER (PARTITION BY appid, review_type ORDER BY page_no, pos) AS idx FROM reviews_flat)
SELECT recommendationid, appid, review_type, '20240101_000000' AS fetch_date,
       count(*) OVER (PARTITION BY appid, review_type) AS total_reviews FROM capped WHERE idx <= 7""")
def feed_reviews(spark, sf):
    rows = feed.feed_reviews(feed_pages(spark, sf), cap=7, stamp="20240101_000000")
    return rows.select("recommendationid", "appid", "review_type", "fetch_date", "total_reviews")


@query("""
SELECT event_id, user_id, event_type FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS idx FROM events) WHERE idx <= 100""")
def cap_per_key(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return feed.cap_per_request(rows, cap=100, keys=["event_type"], order=["event_id"])


@query("""
SELECT event_id AS run_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS date,
       coalesce(CAST(CASE WHEN event_type <> 'error' THEN user_id END AS VARCHAR), 'Unknown') AS topic_count
FROM events ORDER BY ts DESC, event_id LIMIT 5""")
def recent_runs(spark, sf):
    runs = table(spark, sf, "events").select(
        F.col("event_id").alias("run_id"), F.col("ts").alias("run_ts"),
        F.when(F.col("event_type") != "error", F.col("user_id")).alias("topic_count"),
    )
    return results.recent_runs(runs)


@query("SELECT event_type AS stage, max_by(event_id, ts) AS filename FROM events GROUP BY event_type")
def latest_checkpoint(spark, sf):
    log = table(spark, sf, "events").select(
        F.col("event_type").alias("stage"), F.col("ts").alias("timestamp"), F.col("event_id").alias("filename")
    )
    return results.latest_by_stage(log)
