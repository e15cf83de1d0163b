"""The pipeline's stages on hard rows, and every query of the subpackage."""

import pytest

import corpus_pipeline
from reviewlens.llm import queries


def hard_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = docs.orderBy("doc_id").first()
    extra = [
        (-1, None, "en", "s", 0), (-2, "", "en", None, 0), (-3, "12 34", None, "s", None), (None, "the house and the river " * 9, "en", "s", 1),
        (-4, first["text"], "en", "s", 1), (-4, first["text"], "en", "s", 1), (-5, first["text"] + " thing", "en", "s", 1), (-6, first["text"] * 40, "en", "s", 1),
    ]
    return docs.unionByName(spark.createDataFrame(extra, docs.schema))


def test_stages_take_effect(spark, sf, tmp_path):
    docs = hard_rows(spark, sf)
    columns, ids = docs.columns, {}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        ids[name] = [r["doc_id"] for r in docs.select("doc_id").collect()]
        if name != "packing":
            assert docs.columns == columns
    assert {-1, -2, -3}.isdisjoint(ids["language_id"]) and {-4, -5, -6, None} <= set(ids["language_id"])
    assert len(ids["near_duplicates"]) <= len(ids["line_dedup"]) <= len(ids["language_id"])
    assert len([i for i in ids["near_duplicates"] if i in (-4, -5)]) <= 1
    assert 0 < len(ids["benchmark_decontamination"]) < len(ids["near_duplicates"])
    assert set(ids["packing"]) == set(ids["benchmark_decontamination"])


@pytest.mark.parametrize("number", range(len(corpus_pipeline.STAGES)))
def test_stages_on_an_empty_table(spark, sf, number):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    assert corpus_pipeline.STAGES[number][1](spark, docs, sf).count() == 0


def test_queries_are_named():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
