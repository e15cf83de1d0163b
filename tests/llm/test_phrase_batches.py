"""Counts of phrases are handed on in parts."""

import random
from collections import Counter

import pyarrow as pa
import pytest

from reviewlens.llm import phrase_mining


class Caught(Exception):
    pass


class Texts:
    def mapInArrow(self, run, schema):
        raise Caught(run)


def test_phrases_are_handed_on_in_bounded_batches(spark, monkeypatch):
    make = random.Random(2)
    words = ["w%d" % i for i in range(40)]
    texts = [" ".join(make.choice(words) for _ in range(400)) for _ in range(8)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    monkeypatch.setattr(phrase_mining, "_in_few_tasks", lambda texts: Texts())
    monkeypatch.setattr(phrase_mining, "EMITTED", 50)
    monkeypatch.setattr(phrase_mining, "HELD_TEXTS", 300)
    with pytest.raises(Caught) as caught:
        phrase_mining.frequent_phrases(docs, 2)
    rows = pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), pa.array(texts)], ["lang", "text"])
    found, sizes = Counter(), []
    for batch in caught.value.args[0](iter([rows])):
        sizes.append(batch.num_rows)
        for row in batch.to_pylist():
            found[row["phrase"]] += row["f"]
    assert max(sizes) <= 50 and sum(sizes) > 300
    expected = Counter(" ".join(t.split()[i : i + 2]) for t in texts for i in range(399))
    assert all(found[phrase] == n for phrase, n in expected.items() if n >= 2)
