"""Every training document takes part in the training of the recurrent model."""

from reviewlens.llm import recurrent_lm


def test_every_document_is_in_one_round(spark):
    ids = [None, -1, *range(500)]
    docs = spark.createDataFrame([(i, "a text") for i in ids], "doc_id long, text string")
    found = [r["doc_id"] for n in range(recurrent_lm.ROUNDS) for r in recurrent_lm.of_round(docs, n).collect()]
    assert sorted(found, key=str) == sorted(ids, key=str)
