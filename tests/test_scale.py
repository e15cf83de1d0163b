import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlens import scale
from reviewlens.operators import profile, ranks, sampling
from reviewlens.operators.assignment import order_by_size


def skewed(spark, rows=3000):
    """A third of all rows share one key."""
    key = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50)
    return spark.range(rows).withColumn("k", key)


def test_lookup_paths_agree(spark):
    facts = skewed(spark)
    lookup = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    rows = lambda df: sorted((r["id"], r["k"], r["v"]) for r in df.select("id", "k", F.coalesce("v", F.lit(-1)).alias("v")).collect())
    small = rows(scale.join_lookup(facts, lookup, "k", ["id"]))
    large = rows(scale.join_lookup(facts, lookup, "k", ["id"], max_rows=5))
    assert small == large and len(small) == 3000


def test_running_total_and_ids(spark):
    numbered = ranks.dense_ids(skewed(spark), ["id"]).orderBy("id").collect()
    assert [r["document_id"] for r in numbered] == list(range(3000))
    total = ranks.running_total(skewed(spark), ["id"], "k").agg(F.max("total")).head()[0]
    assert total == skewed(spark).agg(F.sum("k")).head()[0]


def test_exact_sample(spark):
    df = skewed(spark)
    first = sorted(r["id"] for r in sampling.exact_sample(df, 100, ["id"]).collect())
    again = sorted(r["id"] for r in sampling.exact_sample(df.repartition(5), 100, ["id"]).collect())
    assert len(first) == 100 and first == again
    assert sampling.exact_sample(df, 5000, ["id"]).count() == 3000
    assert sampling.exact_sample(df, None, ["id"]).count() == 3000
    share = sampling.share_sample(df, 0.8, ["id"], 1).count()
    assert 2250 < share < 2550


def test_numeric_profile_equals_pandas(spark):
    df = skewed(spark).withColumn("x", F.when(F.col("id") % 7 > 0, F.sin("id")))
    want = df.toPandas()[["id", "k", "x"]].describe()
    for row in profile.numeric_profile(df).collect():
        column = want[row["column"]]
        for ours, theirs in (("count", "count"), ("mean", "mean"), ("std", "std"), ("p25", "25%"), ("p50", "50%"), ("p75", "75%")):
            assert abs(row[ours] - column[theirs]) < 1e-9, (row["column"], ours)


@pytest.mark.parametrize("values", [[7.0], [1.0, 2.0], [3.0, 1.0, 2.0], [5.0] * 50 + [float(i) for i in range(9)]])
def test_quartiles_of_few_rows_and_of_ties(spark, values):
    df = spark.createDataFrame([(v, float(-i)) for i, v in enumerate(values)] + [(None, None)], "a double, b double")
    rows = {r["column"]: r for r in profile.numeric_profile(df).collect()}
    for name, held in (("a", values), ("b", [-i for i in range(len(values))])):
        want = np.percentile(held, [25, 50, 75])
        assert np.allclose([rows[name][q] for q in ("p25", "p50", "p75")], want)
    assert profile.numeric_profile(df.limit(0)).count() == 0


def test_empty_statistics(spark):
    empty = spark.createDataFrame([], "app_id string, review_score int")
    row = profile.dataset_stats(empty).head()
    assert row["review_count"] == 0 and row["positive_percentage"] == 0.0


def test_order_by_size_keeps_outliers(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate([5, 5, 5, 2, -1, -1, 7, 7])], "id int, cluster int")
    got = {r["id"]: r["topic"] for r in order_by_size(df, keys=["id"]).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 2, 4: -1, 5: -1, 6: 1, 7: 1}


def test_checkpoint_folder(spark):
    assert scale.cut_lineage(skewed(spark)).count() == 3000
