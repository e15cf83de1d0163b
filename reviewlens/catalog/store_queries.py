"""Tables written through the sinks of the library and read back through its sources."""

from __future__ import annotations

import uuid

from pyspark.sql import Window, functions as F

from reviewlens.catalog.feed_queries import PAGES_SQL, feed_pages
from reviewlens.catalog.registry import query, table
from reviewlens.catalog.vector_queries import DETAILS_SQL, _details
from reviewlens.functions import formatting
from reviewlens.operators import assignment, sentiment
from reviewlens.plans import explore as exploration, ingest, naming
from reviewlens.scale import shared_folder
from reviewlens.sources import results, review_files
from reviewlens.streaming.ingest import start_ingest


def _folder(spark, name: str) -> str:
    """A new place for the tables of one query."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# --- files of reviews, games and topics -------------------------------------------


@query("""
SELECT doc_id AS recommendationid, text AS review, lang AS language, CASE WHEN doc_id % 2 = 1 THEN n_chars END AS appid FROM documents""")
def review_files_union(spark, sf):
    """Two column orders, texts with newlines and quotes, one of them without a game."""
    base, docs = _folder(spark, "reviews"), table(spark, sf, "documents")
    review, ident = F.col("text").alias("review"), F.col("doc_id").alias("recommendationid")
    lang, game = F.col("lang").alias("language"), F.col("n_chars").cast("long").alias("appid")
    results.write_csv(docs.filter("doc_id % 2 = 0").select(ident, review, lang), f"{base}/even")
    results.write_csv(docs.filter("doc_id % 2 = 1").select(lang, review, ident, game), f"{base}/odd")
    found = ingest.combine_files(spark, f"{base}/*/*.csv", f"{base}/all")
    return found.select("recommendationid", "review", "language", "appid")


@query("SELECT CAST(c_custkey AS BIGINT) AS AppID, c_name AS Name FROM customer")
def game_catalogue(spark, sf):
    path = _folder(spark, "games")
    games = table(spark, sf, "customer")
    results.write_csv(games.select(F.lit(0).alias("_index"), F.col("c_custkey").alias("AppID"), F.col("c_name").alias("Name")), path)
    return review_files.read_catalogue(spark, path)


def _numbered_details(spark, sf):
    """Topic words with numbers as ids (a row per topic)."""
    return _details(spark, sf).withColumn("topic_id", (F.row_number().over(Window.orderBy("topic_id")) - 1).cast("int"))


NUMBERED_SQL = f"""{DETAILS_SQL},
numbered AS (SELECT CAST(row_number() OVER (ORDER BY topic_id) - 1 AS INTEGER) AS topic_id, words FROM details)"""


@query(f"WITH {NUMBERED_SQL} SELECT topic_id, CAST(to_json(words) AS VARCHAR) AS words FROM numbered")
def topic_words_file(spark, sf):
    path = results.write_topic_words(_numbered_details(spark, sf), _folder(spark, "topics"), "lsa", 8)
    return review_files.read_topic_words(spark, path)


@query(f"""
WITH {NUMBERED_SQL}
SELECT topic_id, CAST(to_json(words) AS VARCHAR) AS words,
       words[1] || ' + ' || words[2] || ' + ' || words[3] || ' + ' || words[4] AS topic_name FROM numbered""")
def named_topics_file(spark, sf):
    base = _folder(spark, "names")
    path = results.write_topic_words(_numbered_details(spark, sf), base, "lsa", 8)
    naming.name_exported(spark, path, f"{base}/named")
    return spark.read.schema("topic_id int, words string, topic_name string").options(**review_files.CSV_OPTIONS).csv(f"{base}/named")


@query("SELECT doc_id, CAST(to_json([lang, source]) AS VARCHAR) AS labels FROM documents")
def array_to_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", formatting.to_text(F.array("lang", "source")).alias("labels"))


# --- results of an analysis ---------------------------------------------------------


def _analysis(spark, sf):
    """The tables of an analysis whose topics are the labels of the vectors."""
    rows = table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("int").alias("topic"))
    label = F.when(F.col("vec_id") % 3 == 0, "NEGATIVE").otherwise("POSITIVE")
    return {
        "topic_info": assignment.topic_info(rows),
        "topic_details": rows.groupBy(F.col("topic").alias("topic_id")).agg(F.array(F.lit("word")).alias("words")),
        "document_topics": rows.select(F.col("vec_id").alias("document_id"), "topic"),
        "sentiment_analysis": sentiment.topic_sentiment(rows.select("topic", label.alias("label"), F.lit(0.5).alias("score"))),
    }


@query("""
SELECT CAST(label AS INTEGER) AS topic, count(*) AS "count", count(*) AS documents, count(*) AS sentences,
       '20240101_000000' AS run_id, (SELECT count(*) FROM embeddings) AS num_sentences,
       (SELECT count(DISTINCT label) FROM embeddings) AS num_topics FROM embeddings GROUP BY label""")
def saved_analysis(spark, sf):
    """Saved, copied to another place and loaded from there."""
    base = _folder(spark, "analysis")
    stamp = results.save_analysis(_analysis(spark, sf), base, "20240101_000000", csv=True)
    results.copy_results(spark, base, stamp, f"{base}/copy")
    found = results.load_analysis(spark, f"{base}/copy", stamp)
    documents = found["document_topics"].groupBy("topic").agg(F.count(F.lit(1)).alias("documents"))
    summary = found["summary"].select(
        F.col("timestamp").alias("run_id"), "num_sentences", "num_topics", F.explode("sentiment_analysis").alias("s")
    )
    moods = summary.select("run_id", "num_sentences", "num_topics", "s.topic", F.col("s.sentence_count").alias("sentences"))
    return found["topic_info"].select("topic", "count").join(documents, "topic").join(moods, "topic")


@query("SELECT doc_id, n_chars FROM documents WHERE lang = 'en'")
def stage_checkpoint(spark, sf):
    """The later of two saved states of a stage."""
    base, docs = _folder(spark, "stages"), table(spark, sf, "documents").select("doc_id", "n_chars", "lang")
    results.save_stage(docs, base, "sentences", "run", "20240101_000000")
    results.save_stage(docs.filter("lang = 'en'"), base, "sentences", "run", "20240102_000000")
    results.save_stage(docs.filter("lang = 'de'"), base, "topics", "run", "20240103_000000")
    return results.load_stage(spark, base, "sentences", "run")[0].select("doc_id", "n_chars")


@query("""
SELECT '20240101_000000' AS "timestamp", 'topic_sizes,topic_map' AS visualizations,
       count(DISTINCT label) AS num_topics, count(*) AS num_documents FROM embeddings""")
def plot_run_metadata(spark, sf):
    base = _folder(spark, "plots")
    results.write_plot_metadata(_analysis(spark, sf), ["topic_sizes", "topic_map"], base, "20240101_000000")
    found = spark.read.json(f"{base}/visualization_metadata")
    return found.select("timestamp", F.array_join("visualizations", ",").alias("visualizations"), "num_topics", "num_documents")


# --- ingest ----------------------------------------------------------------------------


@query(f"""
WITH {PAGES_SQL}
SELECT appid, review_type, recommendationid, props AS review, count(*) OVER (PARTITION BY appid, review_type) AS total_reviews
FROM reviews_flat JOIN events ON event_id = recommendationid""")
def feed_ingest(spark, sf):
    """Landed pages ingested twice: the second run changes nothing."""
    base = _folder(spark, "feed")
    feed_pages(spark, sf).write.json(f"{base}/landing")
    for _ in range(2):
        ingest.ingest_feed(spark, f"{base}/landing", f"{base}/table")
    kept = ("recommendationid", "review", "total_reviews")
    return spark.read.parquet(f"{base}/table").select(F.col("appid").cast("long").alias("appid"), "review_type", *kept)


@query(f"""
WITH {PAGES_SQL}
SELECT appid, review_type, unnest(ids) AS recommendationid FROM pages WHERE success = 1""")
def feed_ingest_stream(spark, sf):
    """Structured Streaming over the landed pages, drained."""
    base = _folder(spark, "stream")
    feed_pages(spark, sf).write.json(f"{base}/landing")
    start_ingest(spark, f"{base}/landing", f"{base}/table", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/table").select(F.col("appid").cast("long").alias("appid"), "review_type", "recommendationid")


# --- exploration ------------------------------------------------------------------------


@query("""
WITH counts AS (SELECT o_custkey AS appid, count(*) AS n FROM orders GROUP BY o_custkey)
SELECT 'rows' AS part, NULL AS appid, count(*) AS n FROM orders
UNION ALL SELECT 'game', appid, n FROM counts
UNION ALL SELECT * FROM (SELECT 'top', appid, n FROM counts ORDER BY n DESC, appid LIMIT 10)""")
def explore_tables(spark, sf):
    orders = table(spark, sf, "orders").withColumnsRenamed({"o_custkey": "appid", "o_orderkey": "recommendationid"})
    found = exploration.explore(orders)
    rows = found["shape"].select(F.lit("rows").alias("part"), F.lit(None).cast(orders.schema["appid"].dataType).alias("appid"), F.col("rows").alias("n"))
    games = found["game_counts"].select(F.lit("game").alias("part"), "appid", F.col("reviews_per_game").alias("n"))
    top = found["top_games"].select(F.lit("top").alias("part"), "appid", "n")
    return rows.unionByName(games).unionByName(top)
