"""The whole analysis over repeated and null ids and sentences without known words."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlens.operators import vocabulary
from reviewlens.plans import review_analysis

TALK = {
    0: "sword fight battle dragon castle knight armour shield".split(),
    1: "engine race wheel circuit tyre driver brake gear".split(),
}


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(80):
        words = TALK[i % 2]
        rows.append((i // 2, " ".join(words[j] for j in rng.permutation(8)[:6]) + "."))  # every id occurs twice
    rows += [(1000 + i, f"{i % 10} !") for i in range(30)] + [(None, "sword fight battle dragon castle knight.")]
    reviews = spark.createDataFrame(rows, "recommendationid long, review string").repartition(4)
    found = review_analysis.run_analysis(
        reviews, clustering={"epsilon": 0.5, "min_samples": 3, "min_cluster_size": 5},
        embed={"dimensions": 4, "min_df": 1, "max_df": 1.0},
    )
    return rows, found


def test_repeated_and_null_ids_keep_their_sentences(tables):
    rows, found = tables
    got = found["document_topics"].collect()
    assert sorted(r["sentence"] for r in got) == sorted(text for _, text in rows)
    assert sorted(r["document_id"] for r in got) == list(range(len(rows)))
    assert found["sentences"].filter("recommendationid IS NULL").count() == 1


def test_sentences_without_known_words_are_outliers(tables):
    _, found = tables
    wordless = found["document_topics"].filter(F.col("sentence").rlike("^[0-9] !$"))
    assert {r["topic"] for r in wordless.collect()} == {-1}
    others = found["document_topics"].filter(~F.col("sentence").rlike("^[0-9] !$"))
    assert {r["topic"] for r in others.collect()} - {-1}


def test_stop_list_acts_on_lemmas(spark):
    docs = spark.createDataFrame([(1, ["play", "recommend", "castle"]), (2, ["castle", "dragon"])], "id int, tokens array<string>")
    terms = {r["term"] for r in vocabulary.study_vocabulary(docs, min_df=1, max_df=1.0).collect()}
    assert terms == {"castle", "dragon"}
    every = {r["term"] for r in vocabulary.study_vocabulary(docs, min_df=1, max_df=1.0, stop_words=()).collect()}
    assert every == {"castle", "dragon", "play", "recommend"}
