"""Operators over groups and models against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import oracle
from reviewlens.llm import exact_search, grouping, line_dedup, near_duplicates, queries, recurrent_lm

LOW = str.maketrans({chr(a): chr(a + 32) for a in range(65, 91)})


class Union:
    def __init__(self):
        self.parent = {}

    def find(self, x):
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def near_texts(seed=3):
    make = random.Random(seed)
    word = lambda: "".join(make.choice("abcdefghij") for _ in range(4))
    texts = [None, "", " \n", "one two", "One  TWO", "x", "word " * 20_000]
    for _ in range(12):
        base = [word() for _ in range(60)]
        for _ in range(8):
            copy = list(base)
            for _ in range(make.randint(0, 3)):
                copy[make.randrange(60)] = word()
            texts.append(" ".join(copy))
    return texts


def brute_groups(texts, width):
    sets = []
    for text in texts:
        words = tokens(text)
        sets.append({tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set())
    union = Union()
    for i, a in enumerate(sets):
        union.find(i)
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                union.join(i, j)
    return {i: (len(s), union.find(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize("chunk", [1024, 3])
def test_near_duplicates(spark, monkeypatch, chunk):
    monkeypatch.setattr(near_duplicates, "SKETCH_CHUNK", chunk)
    monkeypatch.setattr(near_duplicates, "SET_CHUNK", chunk)
    texts = near_texts()
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, "only a null id here", 2), (7, texts[7], 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int")
    expected = brute_groups(texts, 4)
    found = near_duplicates.groups(docs, width=4).collect()
    assert len(found) == len(rows)
    for row in found:
        if row["doc_id"] is None:
            assert (row["n_shingles"], row["component_id"], row["kept"]) == (2, None, True)
        else:
            assert (row["n_shingles"], row["component_id"]) == expected[row["doc_id"]]
            assert row["kept"] == (row["doc_id"] == row["component_id"])
    kept = near_duplicates.first_of_groups(docs, width=4)
    assert kept.columns == docs.columns
    roots = sorted({root for _, root in expected.values()})
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == roots
    assert near_duplicates.groups(docs.limit(0)).count() == 0


def test_sketches_merge_and_estimate():
    make = np.random.default_rng(1)
    both, one, two = (make.integers(0, 2**63, n, dtype=np.uint64) for n in (800, 100, 100))
    a, b = near_duplicates.sketch(np.concatenate([both, one])), near_duplicates.sketch(np.concatenate([both, two]))
    assert (near_duplicates.merge(a, b) == near_duplicates.sketch(np.concatenate([both, one, two]))).all()
    found = near_duplicates.estimate(*(np.array([x]) for x in ((a > b).sum(), (a < b).sum(), (a == b).sum(), 900.0, 900.0)))
    assert abs(found[0] - 0.8) < 0.15


def test_slope_decides_as_the_estimate_does():
    make = np.random.default_rng(3)
    size = make.integers(5, 3000, 5000).astype(float)
    other = np.maximum(1, np.round(size * make.uniform(0.4, 2.5, 5000)))
    equal = make.integers(0, 129, 5000)
    greater = make.integers(0, 129 - equal)
    counts = (greater, 128 - greater - equal, equal, size, other)
    estimate = near_duplicates.estimate(*counts)
    for least in (0.0, 0.4, 0.6):
        clear = np.abs(estimate - least) > 1e-4
        assert ((estimate >= least) == near_duplicates.reaches(*counts, least))[clear].all()


def test_forest_equals_union_find():
    make = np.random.default_rng(4)
    for density in (0.01, 0.05, 0.5):
        links = np.triu(make.random((60, 60)) < density, 1)
        links |= links.T
        union = Union()
        for a, b in np.argwhere(links):
            union.join(int(a), int(b))
        asked = []
        label = grouping.forest(60, lambda i, others: asked.append(i) or links[i][others])
        assert label.tolist() == [union.find(i) for i in range(60)]
        assert len(asked) == len(set(asked))


def test_hub_is_dealt_by_salts(spark, monkeypatch):
    monkeypatch.setattr(grouping, "ROWS_OF_PARTITION", 20)
    edges = [(0, i) for i in range(1, 200)] + [(i, i + 1) for i in range(300, 330)]
    union = Union()
    for a, b in edges:
        union.join(a, b)
    found = {r["node"]: r["root"] for r in grouping.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: union.find(x) for edge in edges for x in edge}


def test_names_of_other_columns_never_clash(spark):
    names = ["_row", "_id", "_removed", "removed", "document", "row_hash", "node", "kept_id", "kept_text"]
    schema = "doc_id long, text string, " + ", ".join(f"{name} string" for name in names)
    line = "the very same line of words stands here"
    own = ["apples ripen late in the north", "seven ships left harbour at dawn", "nobody reads the old ledgers"]
    rows = [(i, f"{line}\n{text}", *names) for i, text in enumerate(own)] + [(3, f"{line}\n\t", *names)]
    docs = spark.createDataFrame(rows, schema)
    for kept in (line_dedup.deduplicate(docs), near_duplicates.first_of_groups(docs)):
        assert kept.columns == docs.columns
        assert all(list(r)[2:] == names for r in kept.collect())
    texts = {r["doc_id"]: r["text"] for r in line_dedup.deduplicate(docs).collect()}
    assert line in texts[0] and line not in texts[1] and 3 not in texts
    assert line_dedup.report(docs).count() == 4


def test_components(spark):
    make = random.Random(5)
    edges = [(make.randrange(300), make.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 450)]
    union = Union()
    for a, b in edges:
        union.join(a, b)
    found = {r["node"]: r["root"] for r in grouping.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: union.find(x) for a, b in edges for x in (a, b) if a != b}
    assert grouping.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_lines(rows):
    places = {}
    for doc_id, text in rows:
        for at, line in enumerate((text or "").split("\n")):
            words = line_dedup.normalised(line)
            if len(words.split()) >= line_dedup.MIN_WORDS:
                places.setdefault(words, set()).add((doc_id, at))
    nodes = sorted(places)
    split = [n.split() for n in nodes]
    _, one, two = line_dedup.simhashes([w for x in split for w in x], [len(x) for x in split])
    union = Union()
    for i in range(len(nodes)):
        union.find(i)
        for j in range(i):
            bits = (int(one[i]) ^ int(one[j])) | (int(two[i]) ^ int(two[j])) << 64
            cuts = [0, 21, 42, 64, 85, 106, 128]
            meets = any(bits >> a & (1 << b - a) - 1 == 0 for a, b in zip(cuts, cuts[1:]))
            if meets and bits.bit_count() <= line_dedup.MOST_BITS and line_dedup.similar(nodes[i], nodes[j]):
                union.join(i, j)
    groups = {}
    for i, node in enumerate(nodes):
        groups.setdefault(union.find(i), set()).update(places[node])
    return {place for group in groups.values() for place in sorted(group)[1:]}


@pytest.mark.parametrize("chunk", [1024, 2])
def test_line_dedup(spark, monkeypatch, chunk):
    monkeypatch.setattr(line_dedup, "BUCKET_CHUNK", chunk)
    monkeypatch.setattr(line_dedup, "TEXT_CHUNK", chunk)
    make = random.Random(4)
    lines = [" ".join("".join(make.choice("abcdef") for _ in range(5)) for _ in range(60)) for _ in range(12)]
    near = [line[:30] + "x" + line[31:] for line in lines for _ in (0, 1)] + [line.upper() + "!" for line in lines]
    texts = ["\n".join(make.sample(lines + near, 4) + ["short line", "", f"{make.random()} one two three four"]) for _ in range(25)]
    texts += [None, "", "\n\n", "w " * 9000, lines[0]]
    rows = [(i, t, 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, place int")
    removed = {(r["doc_id"], p) for r in line_dedup.report(docs).collect() for p in r["removed"]}
    assert removed == brute_lines([(i, t) for i, t, _ in rows])
    done = line_dedup.deduplicate(docs)
    assert done.columns == docs.columns
    kept = {r["doc_id"]: r["text"] for r in done.collect()}
    assert kept[25] is None and kept[26] == "" and kept[27] == "\n\n" and 29 not in kept
    for doc_id, text in kept.items():
        if texts[doc_id]:
            assert text == "\n".join(x for at, x in enumerate(texts[doc_id].split("\n")) if (doc_id, at) not in removed)
    assert line_dedup.deduplicate(docs.limit(0)).count() == 0


def test_edit_distance():
    make = random.Random(2)

    def table(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            after = [i]
            for j, y in enumerate(b, 1):
                after.append(min(row[j] + 1, after[-1] + 1, row[j - 1] + (x != y)))
            row = after
        return row[-1]

    for _ in range(1500):
        a, b = (bytes(make.choice(b"abc ") for _ in range(make.randint(0, 12))) for _ in (0, 1))
        assert line_dedup.edit_distance(a, b) == table(a, b)


def test_search_equals_sql(spark, sf):
    assert oracle.compare(queries.op4_exact_search(spark, sf), queries.OP4_SQL, oracle.connect(sf)) == ""


def test_search_hard_cases(spark):
    make = np.random.default_rng(3)
    rows = [(i, [float(x) for x in make.normal(0, 1, 8)], 7) for i in range(400)]
    rows += [(400, None, 7), (401, [1.0] * 7 + [None], 7), (402, [1.0] * 7 + [float("nan")], 7), (None, [1.0] * 8, 7)]
    rows += [(403, [float("inf")] * 8, 7), (404, [], 7), (405, [9.0, 9.0], 7), (420, [1.0, 2.0], 7)] + [(500 + i, rows[5][1], 7) for i in range(30)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    found = exact_search.top_k(vectors, F.col("vec_id") % 20 == 0, k=5, shard_size=50).collect()
    good = {i: [math.floor(64 * x) for x in v] for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    expected = set()
    for q in (i for i in good if i % 20 == 0):
        scored = sorted((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
        expected |= {(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:5], 1)}
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found} == expected
    assert exact_search.top_k(vectors.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("frequent", [1 << 18, 60])
def test_recurrent_model(spark, sf, monkeypatch, frequent):
    monkeypatch.setattr(recurrent_lm, "FREQUENT", frequent)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    extra = [(-1, None, "known"), (-2, "", None), (None, "Ünseen wörds  here", None), (-3, "the " * 3000, None)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    rows = {r["doc_id"]: r for r in recurrent_lm.train_and_score(docs).collect()}
    texts = {r["doc_id"]: [*tokens(r["text"]), "\n"] for r in docs.collect()}
    assert rows.keys() == texts.keys()
    learn = Counter(t for i, ts in texts.items() if zlib.crc32(str("" if i is None else i).encode()) % 10 for t in ts)
    total = sum(learn.values())
    for i, row in rows.items():
        base = sum(math.log10((learn[t] + 0.1) / (total + 0.1 * (len(learn) + 1))) for t in texts[i])
        assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (len(texts[i]), sum(t in learn for t in texts[i]), total)
        assert abs(row["base_score"] - base) < 1e-6 * max(1, -base) and row["score"] < 0
    assert rows[-1]["score"] == pytest.approx(rows[-2]["score"])
    nothing = recurrent_lm.train_and_score(docs.where("doc_id IN (-1, -2)").where("false"))
    assert nothing.count() == 0


def test_recurrent_model_is_a_distribution_and_learns():
    make = np.random.default_rng(0)
    model = recurrent_lm.GatedModel(make.normal(0, 0.3, recurrent_lm.PARAMETERS))
    every = np.arange(recurrent_lm.WORDS + 1)
    states = np.repeat(make.normal(0, 1, (1, recurrent_lm.HIDDEN)), len(every), axis=0).astype(np.float32)
    assert abs(np.exp(model.log_probability(states, every)).sum() - 1) < 1e-4
    long = [make.integers(0, 1025, n) for n in (500, 3, 130)]
    alone = [model.score([d], 5)[0] for d in long]
    assert np.allclose(model.score(long, 5), alone, rtol=1e-4)
    pattern = [np.tile(np.arange(6), 60) for _ in range(128)]
    model = recurrent_lm.GatedModel.from_counts(np.ones(recurrent_lm.WORDS), 1.0)
    before, optimiser = model.score(pattern[:1], 0)[0], recurrent_lm.Adam()
    for _ in range(6):
        model.train(pattern, 0, optimiser)
    assert model.score(pattern[:1], 0)[0] > before / 3


def test_gradient_by_differences():
    make = np.random.default_rng(0)
    model = recurrent_lm.GatedModel(make.normal(0, 0.3, recurrent_lm.PARAMETERS))
    docs = [make.integers(0, recurrent_lm.WORDS + 1, n) for n in (9, 7, 4)]
    block, inputs, _, mask = next(recurrent_lm._windows(docs, 5, 32))

    class Keep:
        def update(self, _, gradient):
            self.gradient = gradient

    keep = Keep()
    model._train_window(np.zeros((3, recurrent_lm.HIDDEN), np.float32), block, inputs, mask, keep)
    for i in np.argsort(-np.abs(keep.gradient))[:60]:
        loss = []
        for by in (0.01, -0.01):
            moved = model.flat.copy()
            moved[i] += by
            loss.append(-recurrent_lm.GatedModel(moved).score(docs, 5).sum() / mask.sum())
        assert abs((loss[0] - loss[1]) / 0.02 - keep.gradient[i]) < 0.05 * abs(keep.gradient[i]) + 2e-4
