import csv
import json
import os

import pytest
from pyspark.sql import functions as F

from reviewlens.operators import reports, topic_words
from reviewlens.plans import explore, ingest, naming, review_analysis
from reviewlens.sources import feed, results, review_files
from reviewlens.streaming.ingest import start_ingest


def write_csv(path, header, rows):
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(header)
        out.writerows(rows)


def test_files_with_different_column_order(spark, tmp_path):
    write_csv(tmp_path / "a.csv", ["recommendationid", "review", "appid"], [[1, 'say "hi",\nfriend', 10], [2, "", 10]])
    write_csv(tmp_path / "b.csv", ["appid", "voted_up", "recommendationid", "review"], [[20, True, 3, "ok"]])
    rows = {r["recommendationid"]: r for r in review_files.read_reviews(spark, str(tmp_path / "*.csv")).collect()}
    assert rows[1]["review"] == 'say "hi",\nfriend' and rows[1]["appid"] == 10 and rows[1]["voted_up"] is None
    assert rows[2]["review"] is None
    assert rows[3]["appid"] == 20 and rows[3]["voted_up"] is True
    combined = ingest.combine_files(spark, str(tmp_path / "*.csv"), str(tmp_path / "all"))
    assert combined.count() == 3


def test_catalogue_and_topic_words(spark, tmp_path):
    write_csv(tmp_path / "games.csv", ["", "AppID", "Name"], [[0, 7, "Game™"]])
    assert review_files.read_catalogue(spark, str(tmp_path / "games.csv")).collect() == [(7, "Game™")]
    write_csv(tmp_path / "t.csv", ["topic_id", "words", "scores"], [[0, "['a', 'b']", "[0.1, 0.2]"], [1, "", ""]])
    named = naming.name_exported(spark, str(tmp_path / "t.csv"), str(tmp_path / "named"))
    assert {r["topic_id"]: r["topic_name"] for r in named.collect()} == {0: "a + b", 1: "Topic with No Words"}


def page(appid, kind, no, ids, success=1, cursor="next"):
    items = [
        {"recommendationid": i, "review": f"r{i}", "timestamp_created": 1700000000 + (i or 0), "author": {"steamid": (i or 0) * 10, "num_reviews": 2}}
        for i in ids
    ]
    return {"appid": appid, "review_type": kind, "page_no": no, "success": success, "cursor": cursor, "reviews": items}


PAGES = [
    page(1, "positive", 0, [1, 2, 3]), page(1, "positive", 1, [4, 5]), page(1, "positive", 2, []), page(1, "positive", 3, [6]),
    page(1, "negative", 0, [7, 8], cursor="*"), page(1, "negative", 1, [9]),
    page(2, "positive", 0, [10]), page(2, "positive", 1, [11], success=0), page(2, "positive", 2, [12]),
]


def land(folder, pages, name="p"):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("\n".join(json.dumps(p) for p in pages))


def test_feed_rules(spark, tmp_path):
    land(tmp_path / "landing", PAGES)
    pages = feed.read_pages(spark, str(tmp_path / "landing"))
    rows = feed.feed_reviews(pages, cap=4).collect()
    assert sorted(r["recommendationid"] for r in rows) == [1, 2, 3, 4, 7, 8, 10]
    by_id = {r["recommendationid"]: r for r in rows}
    assert by_id[1]["total_reviews"] == 4 and by_id[7]["total_reviews"] == 2 and by_id[10]["author_steamid"] == 100
    progress = ingest.ingest_feed(spark, str(tmp_path / "landing"), str(tmp_path / "reviews"))
    assert {r["appid"]: (r["positive"], r["negative"]) for r in progress.collect()} == {1: (5, 2), 2: (1, 0)}


def test_feed_keeps_pages_without_a_request(spark, tmp_path):
    land(tmp_path / "landing", [{**page, "review_type": None} if page["appid"] == 2 else page for page in PAGES])
    pages = feed.read_pages(spark, str(tmp_path / "landing"))
    rows = feed.feed_reviews(pages).collect()
    assert {r["recommendationid"] for r in rows if r["review_type"] is None} == {10}
    assert {r["total_reviews"] for r in rows if r["review_type"] is None} == {1}


def test_stream_keeps_late_reviews(spark, tmp_path):
    args = [str(tmp_path / n) for n in ("landing", "out", "ckpt")]
    land(tmp_path / "landing", [page(1, "positive", 0, [1, 2])], "first")
    start_ingest(spark, *args).awaitTermination()
    month = 30 * 86400  # written a month before the reviews that landed first
    land(tmp_path / "landing", [page(1, "positive", 1, [3 - month, 4 - month])], "second")
    start_ingest(spark, *args).awaitTermination()
    got = spark.read.parquet(args[1])
    assert sorted(r["recommendationid"] for r in got.collect()) == [3 - month, 4 - month, 1, 2]


def test_repeated_ingest_leaves_the_table_as_it_is(spark, tmp_path):
    landing, target = str(tmp_path / "landing"), str(tmp_path / "reviews")
    land(tmp_path / "landing", [page(1, "positive", 0, [1, 2, None]), page(2, "negative", 0, [4])], "first")
    ids = []
    for _ in range(2):
        ingest.ingest_feed(spark, landing, target)
        rows = spark.read.parquet(target).select("appid", "recommendationid").collect()
        ids.append(sorted(((r[0], r[1]) for r in rows), key=str))
    assert ids[0] == ids[1] == sorted([(1, 1), (1, 2), (1, None), (2, 4)], key=str)
    newer = spark.read.parquet(target).filter("recommendationid = 2").withColumns(
        {"fetch_date": F.lit("9999"), "review": F.lit("edited")}
    )
    feed.write_reviews(newer, target)
    rows = {r["recommendationid"]: r for r in spark.read.parquet(target).collect()}
    assert len(rows) == 4 and rows[2]["review"] == "edited" and rows[1]["review"] != "edited" and 4 in rows


def test_stream_keeps_files_of_an_old_modification_time(spark, tmp_path):
    args = [str(tmp_path / n) for n in ("landing", "out", "ckpt")]
    land(tmp_path / "landing", [page(1, "positive", 0, [1, 2])], "first")
    start_ingest(spark, *args).awaitTermination()
    land(tmp_path / "landing", [page(1, "positive", 1, [3, None])], "restored")
    os.utime(tmp_path / "landing" / "restored.json", (1_000_000_000, 1_000_000_000))
    start_ingest(spark, *args).awaitTermination()
    got = [r["recommendationid"] for r in spark.read.parquet(args[1]).collect()]
    assert sorted(got, key=str) == [1, 2, 3, None]


def test_stream_equals_batch(spark, tmp_path):
    args = [str(tmp_path / n) for n in ("landing", "out", "ckpt")]
    land(tmp_path / "landing", [page(1, "positive", 0, [1, 2, 3]), page(2, "negative", 0, [4])], "first")
    start_ingest(spark, *args).awaitTermination()
    land(tmp_path / "landing", [page(1, "positive", 1, [3, 5]), page(2, "negative", 1, [6], success=0)], "second")
    start_ingest(spark, *args).awaitTermination()
    got = spark.read.parquet(args[1])
    assert sorted(r["recommendationid"] for r in got.collect()) == [1, 2, 3, 4, 5]
    assert {r["appid"] for r in got.select("appid").collect()} == {1, 2}


@pytest.fixture(scope="module")
def tables(spark):
    info = spark.createDataFrame([(0, 3), (-1, 2)], "topic int, count long")
    return {
        "topic_info": info,
        "topic_details": spark.createDataFrame([(0, ["a", "b"], [0.5, 0.25])], "topic_id int, words array<string>, scores array<double>"),
        "document_topics": spark.createDataFrame([(i, 0 if i < 3 else -1, f"s{i}") for i in range(5)], "document_id long, topic int, sentence string"),
        "sentiment_analysis": spark.createDataFrame(
            [(0, 0.5, 3, 0.9, 0.1), (-1, 1.0, 2, 0.8, None)],
            "topic int, sentiment_mean double, sentence_count long, confidence_mean double, confidence_std double",
        ),
    }


def test_results_round_trip(spark, tmp_path, tables):
    base = str(tmp_path / "results")
    for stamp in ("20240101_000000", "20240301_000000", "20240201_000000"):
        assert results.save_analysis(tables, base, stamp, csv=True) == stamp
    loaded = results.load_analysis(spark, base, "20240201_000000")
    assert set(loaded) == {*results.ARTEFACTS, "summary"}
    summary = loaded["summary"].head()
    assert (summary["num_sentences"], summary["num_topics"], len(summary["sentiment_analysis"])) == (5, 2, 2)
    recent = results.recent_analyses(spark, base, 2).collect()
    assert [(r["run_id"], r["date"], r["topic_count"]) for r in recent] == [
        ("20240301_000000", "2024-03-01 00:00:00", "2"), ("20240201_000000", "2024-02-01 00:00:00", "2"),
    ]
    results.copy_results(spark, base, "20240101_000000", str(tmp_path / "copy"))
    assert results.load_analysis(spark, str(tmp_path / "copy"), "20240101_000000")["topic_details"].count() == 1
    details = spark.read.option("header", True).options(**review_files.CSV_OPTIONS).csv(f"{base}/csv/topic_details_20240101_000000")
    assert details.head()["words"] == '["a","b"]'


def test_stages(spark, tmp_path, tables):
    base = str(tmp_path / "stages")
    assert results.load_stage(spark, base, "topics", "abc") == (None, False)
    results.save_stage(spark.range(3), base, "topics", "abc", "20240101_000000")
    results.save_stage(spark.range(5), base, "topics", "abc", "20240102_000000")
    saved, found = results.load_stage(spark, base, "topics", "abc")
    assert found and saved.count() == 5
    assert results.load_stage(spark, base, "other", "abc") == (None, False)


def test_report_and_metadata(spark, tmp_path, tables):
    terms = spark.createDataFrame([(t, f"w{i}", float(i + t)) for t in (0, 1) for i in range(25)], "topic int, term string, weight double")
    report = topic_words.report_rows(terms, topic_words.importance(terms))
    metrics = dict(n_topics=2, coherence=0.1, diversity=0.2, stability=0.3, performance=0.4, combined_score=0.5)
    results.write_report(metrics, report, str(tmp_path / "report"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "report")).collect()]
    assert lines[1] == "Number of topics: 2" and lines[8] == "Topic 1 (Importance: 325.0000):" and lines[9] == "  - w24: 25.0000"
    assert sum(line.startswith("  - ") for line in lines) == 38
    results.write_plot_metadata(tables, ["topic_sizes"], str(tmp_path / "plots"), "20240101_000000")
    row = spark.read.json(str(tmp_path / "plots" / "visualization_metadata")).head()
    assert row["num_topics"] == 2 and row["num_documents"] == 5
    info = tables["topic_info"]
    assert [r["topic"] for r in reports.leading_topics(info).collect()] == [0]


def test_explore(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = explore.explore(docs, "source", "doc_id")
    assert found["shape"].head()["rows"] == docs.count() and found["top_games"].count() == 10


def test_whole_analysis(spark, tmp_path):
    words = ["combat", "story", "graphics", "crash", "music", "quest"]
    rows = [(i, f"[b]The {words[i % 3]} is {words[i % 3]} good.[/b] I hate the {words[3 + i % 3]} and {words[3 + i % 3]}!") for i in range(120)]
    reviews = spark.createDataFrame(rows, "recommendationid long, review string")
    run = review_analysis.run_and_save(
        reviews, str(tmp_path / "out"), sample_size=100,
        clustering={"epsilon": 0.3, "min_samples": 5, "min_cluster_size": 10},
        embed={"dimensions": 12, "min_df": 1}, 
    )
    saved = results.load_analysis(spark, str(tmp_path / "out"), run)
    assert saved["document_topics"].count() == 200
    ids = sorted(r["document_id"] for r in saved["document_topics"].collect())
    assert ids == list(range(200))
    assert set(saved) == {*results.ARTEFACTS, *results.MORE_TABLES, "summary"}
    topics = {r["topic"] for r in saved["topic_info"].collect()}
    assert {r["topic"] for r in saved["topic_vectors"].collect()} == topics
    assert saved["topic_terms"].filter("topic >= 0").select("topic").distinct().count() == 6
    assert saved["topic_names"].count() >= 6 and saved["markup_usage"].count() > 0
    found = saved["sentiment_analysis"].filter("topic >= 0").collect()
    assert len(found) == 6 and {r["sentiment_mean"] for r in found} == {1.0, -1.0}
