import math

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from reviewlens.functions import special
from reviewlens.operators import embedding, lda, matrix as matrix_sums, nmf, resamples, sampling, svd, topic_model
from reviewlens.plans import fixed_study, topic_study

TERMS = [f"t{i:02d}" for i in range(30)]


@pytest.fixture(scope="module")
def matrix():
    rng = np.random.default_rng(1)
    groups = np.repeat([0, 1, 2], [60, 40, 20])
    x = (rng.random((120, 30)) < 0.05).astype(float)
    for i, g in enumerate(groups):
        x[i, g * 10 : g * 10 + 10] += rng.integers(0, 4, 10)
    return x


@pytest.fixture(scope="module")
def features(spark, matrix):
    rows = [(i, Vectors.sparse(30, [(j, float(v)) for j, v in enumerate(r) if v])) for i, r in enumerate(matrix)]
    return spark.createDataFrame(rows, ["id", "features"]).repartition(5).persist()


def test_lsa_equals_numpy(features, matrix):
    model = svd.fit_lsa(features, 4, TERMS, rounds=12)
    _, s, vt = np.linalg.svd(matrix, full_matrices=False)
    assert np.allclose(model.singular_values, s[:4], rtol=1e-6)
    assert np.allclose(model.components @ model.components.T, np.eye(4), atol=1e-9)
    assert np.allclose(np.abs((model.components * vt[:4]).sum(axis=1)), 1, atol=1e-5)
    scores = matrix @ model.components.T
    assert abs(model.performance(features) - scores.var(axis=0).sum() / matrix.var(axis=0).sum()) < 1e-9
    got = {r["id"]: r["distribution"] for r in model.transform(features, ["id"]).collect()}
    assert np.allclose([got[i] for i in range(120)], scores)


def test_lsa_leading_components(features):
    wide, narrow = svd.fit_lsa(features, 5, TERMS).leading(3), svd.fit_lsa(features, 3, TERMS)
    assert wide.k == 3 and np.allclose(wide.singular_values, narrow.singular_values, rtol=1e-5)
    assert np.allclose(wide.components, narrow.components, atol=1e-2)


def test_lsa_is_repeatable(features):
    a, b = svd.fit_lsa(features, 3, TERMS), svd.fit_lsa(features.repartition(2), 3, TERMS)
    assert np.allclose(a.components, b.components, atol=1e-6)


def test_nmf(features, matrix):
    model = nmf.fit_nmf(features, 3, TERMS, rounds=8)
    assert (model.components >= 0).all()
    assert all(b <= a * (1 + 1e-6) for a, b in zip(model.errors, model.errors[1:]))
    got = {r["id"]: r["distribution"] for r in model.transform(features, ["id"]).collect()}
    w = np.array([got[i] for i in range(120)])
    assert (w >= 0).all()
    error = np.linalg.norm(matrix - w @ model.components)
    assert abs(error + model.performance(features)) < 1e-6
    assert error < 0.75 * np.linalg.norm(matrix)


def test_nmf_stops_and_dense_rows_are_refused(spark, features, matrix):
    model = nmf.fit_nmf(features, 3, TERMS)
    assert 1 < len(model.errors) < nmf.MOST_ROUNDS
    assert model.errors[-2] - model.errors[-1] <= nmf.TOLERANCE * model.errors[0]
    dense = spark.createDataFrame([(0, Vectors.dense(matrix[0]))], ["id", "features"])
    with pytest.raises(Exception, match="sparse vectors are needed"):
        nmf._pass(dense.select("features"), model.components)


def test_lda(spark, features):
    model = lda.fit_lda(features, 3, TERMS, iterations=15)
    assert np.allclose(model.weights().sum(axis=1), 1)
    shares = [sum(r["distribution"]) for r in model.transform(features, ["id"]).collect()]
    assert np.allclose(shares, 1)
    assert model.performance(features) < 0
    export = topic_model.topic_export(model, spark, 5).collect()
    assert [len(r["words"]) for r in export] == [5, 5, 5]
    assert all(list(r["scores"]) == sorted(r["scores"], reverse=True) for r in export)


def test_lda_recovers_planted_topics(features):
    model = lda.fit_lda(features, 3, TERMS)
    weights = model.weights()
    shares = np.array([[weights[t, g * 10 : g * 10 + 10].sum() for g in range(3)] for t in range(3)])
    assert sorted(shares.argmax(axis=1)) == [0, 1, 2] and shares.max(axis=1).min() > 0.8
    passes = lda.fit_lda_passes(features, 3, TERMS, passes=4)
    assert np.allclose(passes.weights().sum(axis=1), 1)
    shares = np.array([[passes.weights()[t, g * 10 : g * 10 + 10].sum() for g in range(3)] for t in range(3)])
    assert sorted(shares.argmax(axis=1)) == [0, 1, 2]


def plain_lda(matrix, components, prior, passes):
    """Variational Bayes one document at a time; the topics and the bound before each pass."""
    bounds = []
    for _ in range(passes):
        topics = np.exp(special.digamma(components) - special.digamma(components.sum(axis=1))[:, None])
        counts, bound = np.zeros_like(components), 0.0
        for row in matrix:
            weights = np.ones(len(components)) if row.any() else np.full(len(components), prior)
            for _ in range(lda.MOST_UPDATES if row.any() else 0):
                spread = np.exp(special.digamma(weights) - special.digamma(weights.sum()))
                new = prior + spread * ((row / np.maximum(spread @ topics, 1e-100)) @ topics.T)
                change, weights = np.abs(new - weights).mean(), new
                if change < lda.MEAN_CHANGE:
                    break
            logs = special.digamma(weights) - special.digamma(weights.sum())
            mixed = np.exp(logs) @ topics
            counts += np.exp(logs)[:, None] * topics * (row / np.maximum(mixed, 1e-100))
            bound += row[row > 0] @ np.log(mixed[row > 0]) + ((prior - weights) * logs).sum()
            bound += sum(math.lgamma(w) - math.lgamma(prior) for w in weights) + math.lgamma(prior * len(weights)) - math.lgamma(weights.sum())
        for topic in components:
            logs = special.digamma(topic) - special.digamma(topic.sum())
            bound += ((prior - topic) * logs).sum() + sum(math.lgamma(w) - math.lgamma(prior) for w in topic)
            bound += math.lgamma(prior * len(topic)) - math.lgamma(topic.sum())
        bounds.append(bound)
        components = prior + counts
    return components, bounds


def test_lda_equals_a_plain_version(features, matrix):
    model = lda.fit_lda(features, 3, TERMS, iterations=4)
    components, bounds = plain_lda(matrix, lda._start(3, 30, 42), 1 / 3, 4)
    assert np.allclose(model.components, components, rtol=1e-6)
    assert np.allclose(model.bounds, bounds, rtol=1e-9)


def test_lda_bound_never_falls(features):
    bounds = np.array(lda.fit_lda(features, 3, TERMS).bounds)
    assert len(bounds) > 3 and (np.diff(bounds) >= -1e-3 * np.abs(bounds[:-1])).all() and bounds[-1] > bounds[0]


def test_digamma_and_gammaln():
    x = np.concatenate([np.geomspace(1e-3, 1e6, 300), [1.0, 2.0, 7.999, 8.0]])
    assert np.allclose(special.gammaln(x), [math.lgamma(v) for v in x], rtol=1e-11, atol=1e-11)
    h = 1e-5 * x
    slope = (special.gammaln(x + h) - special.gammaln(x - h)) / (2 * h)
    assert np.allclose(special.digamma(x), slope, rtol=1e-4, atol=1e-4)
    assert abs(special.digamma(1.0) + 0.5772156649015329) < 1e-12


def test_stability_and_dominant(features):
    model = svd.fit_lsa(features, 2, TERMS)
    assert topic_model.best_match_mean(model, model) == pytest.approx(1)
    assert 0.8 < topic_model.stability(model, features, ["id"], runs=2) <= 1 + 1e-9
    dominant = topic_model.first_max_topics(nmf.fit_nmf(features, 3, TERMS), features, ["id"])
    parts = dominant.withColumn("g", F.when(F.col("id") < 60, 0).when(F.col("id") < 100, 1).otherwise(2))
    best = parts.groupBy("g", "topic").count().groupBy("g").agg(F.max("count").alias("n")).agg(F.sum("n")).head()[0]
    assert best > 100


def test_resamples_share_the_passes_of_the_model(features, monkeypatch):
    passes = []
    monkeypatch.setattr(resamples, "fold", lambda *a, **o: passes.append(1) or matrix_sums.fold(*a, **o))
    model, again = resamples.fit_lsa_resampled(features, 3, TERMS, ["id"], runs=3)
    together = len(passes)
    assert np.allclose(model.components, svd.fit_lsa(features, 3, TERMS).components, atol=1e-6)
    alone = []
    monkeypatch.setattr(svd, "fold", lambda *a, **o: alone.append(1) or matrix_sums.fold(*a, **o))
    for run, other in enumerate(again):
        before = len(alone)
        single = svd.fit_lsa(sampling.share_sample(features, 0.8, ["id"], seed=run), 3, TERMS)
        assert np.allclose(other.components, single.components, atol=1e-6)
        assert len(alone) - before <= together
    # a study of four fits costs no more passes than two
    assert together < len(alone) and together <= 2 * max(1, len(alone) // 3)


def token_docs(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [TERMS[(i % 3) * 10 + int(j)] for j in rng.integers(0, 10, 25)]) for i in range(90)]
    return spark.createDataFrame(rows, "id int, tokens array<string>")


@pytest.mark.parametrize("method", ["lsa", "lda", "nmf"])
def test_topic_count_study(spark, method):
    options = {"iterations": 5} if method == "lda" else {}
    data = topic_study.study_input(token_docs(spark), ["id"], method, min_df=1)
    found = topic_study.find_topic_count(data, (2, 3), stability_runs=1, gate=False, **options)
    rows = found.metrics.collect()
    assert len(rows) == 2 and found.model.k == found.best["n_topics"]
    assert found.best["combined_score"] == max(r["combined_score"] for r in rows)
    report = topic_study.report(found.model, spark)
    assert report.count() == found.model.k * 19
    none = topic_study.find_topic_count(data, (3,), stability_runs=1, **options)
    assert none.best is None and none.metrics.head()["reason"] is not None


def test_fixed_study(spark, tmp_path):
    docs = token_docs(spark).select("id", F.array_join(F.transform("tokens", lambda t: F.translate(t, "0123456789", "abcdefghij")), " ").alias("review"))
    done = fixed_study.run_fixed(docs, "review", ["id"], str(tmp_path), methods=("lsa",), counts=(3,))
    assert done[0]["n_topics"] == 3 and -1 <= done[0]["c_v"] <= 1 + 1e-9
    assert spark.read.option("header", True).csv(done[0]["path"]).count() == 3


# --- reduction -----------------------------------------------------------------


def blobs():
    rng = np.random.default_rng(7)
    copies = np.tile([[5.0, 5.0, 5.0]], (300, 1))  # a third of all rows is one point
    a = rng.normal(0, 0.25, (250, 3))
    b = rng.normal(2.5, 0.25, (150, 3))
    noise = rng.uniform(-6, 8, (200, 3))
    return np.vstack([copies, a, b, noise])


def test_reduction_and_kmeans(spark):
    points = blobs()
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id int, embedding array<double>")
    reduced = embedding.reduce_dimensions(df, ["id"], 2)
    assert {len(r["reduced"]) for r in reduced.collect()} == {2}
    topics = embedding.kmeans_topics(reduced, ["id"], 3)
    assert {r["topic"] for r in topics.collect()} == {0, 1, 2}
