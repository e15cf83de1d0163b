"""What a pass over the documents leaves behind."""

import glob
import os
import time

import numpy as np
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from reviewlens.operators import embedding, matrix
from reviewlens.plans import topic_study
from reviewlens.scale import cut_lineage, released


def shuffle_files(spark):
    folder = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for top in folder for f in glob.glob(os.path.join(top, "**", "shuffle_*.data"), recursive=True)}


def all_gone(spark, before):
    until = time.time() + 20  # Spark removes them beside its work
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    return not shuffle_files(spark) - before


def test_a_pass_hands_on_few_matrices_and_no_shuffle_files(spark):
    vectors = [(Vectors.sparse(4, {i % 4: 1.0}),) for i in range(600)]
    rows = spark.createDataFrame(spark.sparkContext.parallelize(vectors, 300), ["features"])
    starts = spark.sparkContext.accumulator(0)

    def start():
        starts.add(1)
        return {"n": np.zeros(4)}

    def step(totals, indices, values, at):
        totals["n"] += np.bincount(indices, values, 4)

    before = shuffle_files(spark)
    found = matrix.fold(rows, 4, start, step)["n"]
    assert found.tolist() == [150.0] * 4
    assert starts.value <= matrix.TASKS * spark.sparkContext.defaultParallelism + 1  # each partition before
    assert all_gone(spark, before)


def test_shuffle_files_of_a_checkpoint_go(spark):
    frame = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    before, setting = shuffle_files(spark), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    kept = cut_lineage(frame)
    assert all_gone(spark, before)
    assert sorted(r["k"] for r in kept.collect()) == list(range(7))
    assert sorted(r["count"] for r in released(frame).collect()) == [142] + [143] * 6 or kept.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting


def kept_tables(spark):
    return {i for i in spark.sparkContext._jsc.getPersistentRDDs().keySet()}


def test_tokens_do_not_stay_beside_their_vectors(spark):
    words = [f"w{i}" for i in range(12)]
    tokens = spark.createDataFrame([(i, [words[(i + j * j) % 12] for j in range(5)]) for i in range(60)], "doc_id long, tokens array<string>")
    spark.catalog.clearCache()
    limits = {"min_df": 1, "max_df": 1.0}
    data = topic_study.study_input(tokens, ["doc_id"], "lsa", **limits)
    assert len(kept_tables(spark)) == 2  # the vectors and the vocabulary; the tokens too before
    assert data.features.count() == 60
    spark.catalog.clearCache()
    assert embedding.embed_by_lsa(tokens, ["doc_id"], 4, **limits).count() == 60
    assert len(kept_tables(spark)) == 1
    spark.catalog.clearCache()
