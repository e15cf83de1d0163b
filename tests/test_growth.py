"""Steps whose cost must follow the rows, not the number of games, columns or readers."""

import os

import numpy as np
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from reviewlens.catalog import vector_queries
from reviewlens.functions import special
from reviewlens.operators import class_tfidf, embedding, lda, matrix, vocabulary
from reviewlens.sources import feed


def test_review_table_has_bounded_folders(spark, tmp_path):
    path = str(tmp_path / "table")
    games = spark.range(600).select(
        F.col("id").alias("appid"), F.lit("all").alias("review_type"), F.col("id").alias("recommendationid"), F.lit("1").alias("fetch_date")
    )
    feed.write_reviews(games, path)
    feed.write_reviews(games.filter("appid < 5").withColumn("fetch_date", F.lit("2")), path)
    assert sum(os.path.isdir(os.path.join(path, name)) for name in os.listdir(path)) <= feed.SHARDS
    found = {r["appid"]: r["fetch_date"] for r in spark.read.parquet(path).collect()}
    assert len(found) == 600 and {a for a, d in found.items() if d == "2"} == set(range(5))


def test_texts_read_once_are_not_kept(monkeypatch, spark):
    def kept(*_):
        raise AssertionError("token lists kept for one reader")

    docs = spark.createDataFrame([(1, "a", ["x", "y"]), (2, "b", ["x"])], "doc_id long, source string, tokens array<string>")
    monkeypatch.setattr(vector_queries, "study_docs", kept)
    monkeypatch.setattr(vector_queries, "_study_docs", lambda *_: docs, raising=False)
    assert {(r["topic"], r["term"]) for r in vector_queries.source_weights(spark, "").collect()} == {("a", "x"), ("a", "y"), ("b", "x")}


def test_embedding_reads_its_tokens_once(spark):
    drawn = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            drawn.add(batch.num_rows)
            yield batch

    words = [f"w{i}" for i in range(12)]
    rows = [(i, words[i % 12 :] + words[: i % 5]) for i in range(60)]
    tokens = spark.createDataFrame(rows, "id long, tokens array<string>").mapInArrow(seen, "id long, tokens array<string>")
    embedding.embed_by_lsa(tokens, ["id"], 3, min_df=1, max_df=1.0).count()
    assert drawn.value == 60


def test_vector_sums(spark):
    vectors = [Vectors.sparse(5, [(1, 0.5), (3, 0.0), (4, 0.25)]), Vectors.sparse(5, []), Vectors.sparse(5, [(0, -1.0)])]
    df = spark.createDataFrame(list(enumerate(vectors)), ["id", "features"]).coalesce(1)
    found = {r["id"]: (r["terms"], r["total"]) for r in vocabulary.vector_sums(df, ["id"]).collect()}
    assert found == {0: (2, 0.75), 1: (0, 0.0), 2: (1, -1.0)}


def test_bag_of_words_in_pieces(spark):
    lists = [["a", "b"] * 40_000, None, [], ["b", None], ["c"] * 70_000, ["a"]]
    df = spark.createDataFrame(list(enumerate(lists)), "id long, tokens array<string>").coalesce(1)
    found = {(r["id"], r["term"]): r["tf"] for r in vocabulary.bag_of_words(df, ["id"]).collect()}
    assert found == {(0, "a"): 40_000, (0, "b"): 40_000, (3, "b"): 1, (3, None): 1, (4, "c"): 70_000, (5, "a"): 1}


def test_limit_by_topics(spark):
    rows = [("a", "x", 2), ("b", "x", 1), ("a", "y", 1), ("c", "z", 1), ("b", "z", 1), ("a", "z", 1), ("a", None, 1), ("b", None, 1)]
    counts = spark.createDataFrame(rows, "topic string, term string, tf long")
    kept = class_tfidf.limit_by_topics(counts)
    assert sorted(tuple(r) for r in kept.select("topic", "term", "tf").collect()) == [("a", "x", 2), ("b", "x", 1)]
    # one shuffle of the counts by term, and none for the topics of a term apart
    assert kept._jdf.queryExecution().sparkPlan().toString().count("SortMergeJoin") == 0


def test_sparse_products_and_documents():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 3, (40, 30)) * (rng.random((40, 30)) < np.linspace(0, 1, 40)[:, None])
    starts = np.r_[0, np.cumsum((x > 0).sum(axis=1))].astype(np.int32)
    indices, values = np.nonzero(x)[1].astype(np.int32), x[x > 0].astype(float)
    q, into = rng.standard_normal((30, 4)), np.zeros((30, 4))
    matrix.transpose_times(indices, values, starts, matrix.times(indices, values, starts, q), into)
    assert np.allclose(into, x.T @ (x @ q))
    assert np.allclose(special.exp_digamma(np.array([0.01, 1, 7.9, 300])), np.exp(special.digamma(np.array([0.01, 1, 7.9, 300]))))
    topics = rng.random((30, 3)) + 0.01
    weights, _ = lda.solve_documents(indices, values, starts, topics, 0.3)
    for row, counts in enumerate(x):  # each row on its own, as it is defined
        own = np.full(3, 1.0 if counts.any() else 0.3)
        for _ in range(lda.MOST_UPDATES if counts.any() else 0):
            spread = np.exp(special.digamma(own) - special.digamma(own.sum()))
            new = 0.3 + spread * ((counts / (topics @ spread)) @ topics)
            moved, own = np.abs(new - own).mean(), new
            if moved < lda.MEAN_CHANGE:
                break
        assert np.allclose(weights[row], own)
