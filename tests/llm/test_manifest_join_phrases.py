"""The Merkle manifest, the n-gram join and phrase mining against plain versions on hard rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reviewlens.llm import common, merkle_manifest, ngram_join, phrase_mining

LOW = str.maketrans({chr(a): chr(a + 32) for a in range(65, 91)})
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pos string, g int, node string, row double, n int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def table_of(spark, rows):
    """Rows of (doc_id, text, lang, source, n_chars) with further columns of clashing names."""
    return spark.createDataFrame([(*row, "p", 1, "x", 0.5, 3) for row in rows], SCHEMA).repartition(5)


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], row[1])))


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 2])) for i in range(0, len(levels[-1]), 2)])
    return levels


def siblings_of(levels, place):
    for level in levels[:-1]:
        other = place ^ 1
        found = level[other] if other < len(level) else ""
        yield (found, "") if place & 1 else ("", found)
        place >>= 1


def brute_manifest(rows, tampered):
    langs = defaultdict(list)
    for row in rows:
        langs[row[2]].append(row)
    order = sorted(langs, key=lambda lang: (lang is not None, (lang or "").encode()))
    for lang in order:
        langs[lang].sort(key=lambda row: (row[0] is not None, row[0] or 0, leaf_of(row)))
    trees = {lang: levels_of([leaf_of(row) for row in langs[lang]]) for lang in order}
    top = levels_of([trees[lang][-1][0] for lang in order])
    for number, lang in enumerate(order):
        for place, row in enumerate(langs[lang]):
            path = [*siblings_of(trees[lang], place), *siblings_of(top, number)]
            node = leaf_of((*row[:4], row[4] + 1)) if tampered(row) else leaf_of(row)
            for before, after in path:
                node = sha(before + node + after)
            yield (
                row[0], lang, leaf_of(row), trees[lang][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), node, node == top[-1][0]
            )


def manifest_rows(case):
    if case == "one row":
        return [(5, "text", "en", None, 3)]
    if case == "one group":
        return [(i, f"t{i}", None, "s", None) for i in range(9)]
    rows = [(i, f"text {i} é", random.Random(i).choice(["en", "en", "de", None, "Z", "zh"]), "s", i) for i in range(300)]
    rows += [(i, "x" * 100_000, "en", None, 1) for i in range(300, 303)]
    rows += [(7, "other", "en", "s", 1), (7, "other", "en", "s", 1), (7, "third", "en", "s", 1), (None, None, None, None, None), (None, "", "", "", 0)]
    return rows


@pytest.mark.parametrize("block", [2, 8])
@pytest.mark.parametrize("case", ["one row", "one group", "mixed"])
def test_manifest(spark, monkeypatch, case, block):
    monkeypatch.setattr(merkle_manifest, "LEVELS", block)
    monkeypatch.setattr(merkle_manifest, "BLOCK", 1 << block)
    rows = manifest_rows(case)
    crc = F.crc32(F.col("doc_id").cast("string"))
    changed = {"n_chars": F.when(crc % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    found = merkle_manifest.manifest(table_of(spark, rows), FIELDS, "lang", "doc_id", changed).drop("siblings")
    tampered = lambda row: row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
    want = list(brute_manifest(rows, tampered))
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))
    if case == "mixed":
        assert {row[-1] for row in want} == {True, False}


def test_manifest_of_nothing(spark):
    empty = table_of(spark, [(1, "", "", "", 1)]).where("doc_id = 2")
    assert merkle_manifest.manifest(empty, FIELDS, "lang", "doc_id").count() == 0


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def brute_join(rows, width, percent):
    sets = []
    for row in rows:
        words = tokens(row[1])
        sets.append(frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset())
    n = len(rows)
    linked = [[j for j in range(n) if j != i and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])] for i in range(n)]
    for i in range(n):
        reached, todo = {i}, [i]
        while todo:
            for j in linked[todo.pop()]:
                if j not in reached:
                    reached.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in reached if rows[j][0] is not None]
        yield rows[i][0], len(sets[i]), min(ids, default=None), len(linked[i])


def join_rows(seed=5):
    make = random.Random(seed)
    word = lambda: "".join(make.choice("abcdefghij") for _ in range(4))
    passage = " ".join(word() for _ in range(30))  # common to many documents that are not alike
    texts = [None, "", " \n", "one two", "One  TWO", "x", "word " * 20_000]
    for _ in range(8):
        base = [word() for _ in range(60)]
        for _ in range(12):
            copy = list(base)
            for _ in range(make.randint(0, 3)):
                copy[make.randrange(60)] = word()
            texts.append(" ".join(copy))
        texts.append(passage + " " + " ".join(base[:40]))
    rows = [(i, text, "en", "s", 1) for i, text in enumerate(texts)]
    rows += [rows[20], rows[20], (None, texts[30], "en", "s", 1), (None, passage, "en", "s", 1), (-3, texts[-2], None, None, None)]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_ngram_join(spark, monkeypatch, small):
    if small:  # divided columns, ties and several row blocks
        for name, value in {"PAIRED": 3, "ROWS": 4, "FREQUENT_SETS": 4, "PARTS": 3, "LEAST": 8, "STRIDE": 2, "ENTRIES": 900, "CELLS": 2000}.items():
            monkeypatch.setattr(ngram_join, name, value)
    rows = join_rows()
    found = [tuple(r) for r in ngram_join.similar(table_of(spark, rows)).collect()]
    assert sorted(found, key=str) == sorted(brute_join(rows, 5, 80), key=str)


def test_ngram_join_of_nothing(spark):
    assert ngram_join.similar(table_of(spark, join_rows()).where("doc_id = -9")).count() == 0


def test_frequent_ngrams_are_bounded_and_ordered(spark, monkeypatch):
    sets = [(2, [1, 2, 3, 10 + i]) for i in range(6)] + [(2, [3, 4, 50 + i, 60 + i]) for i in range(4)]
    classes = spark.createDataFrame(sets, "stride long, least array<long>")
    monkeypatch.setattr(ngram_join, "FREQUENT_SETS", 5)
    grams, places = ngram_join._frequent(classes)
    assert dict(zip(grams.tolist(), places.tolist())) == {4: 0, 1: 1, 2: 2, 3: 3}
    monkeypatch.setattr(ngram_join, "FREQUENT", 2)
    assert ngram_join._frequent(classes)[0].tolist() == [3]


def test_words_of_a_column(monkeypatch):
    monkeypatch.setattr(common, "HASHED_BYTES", 16)
    texts = ["ab cd", None, "", "ef", "  x ", "gé" * 30 + " ab", " ", "cd", ""]
    column = pa.array(["zz", *texts, "yy"]).slice(1, len(texts))
    found = common.words_of(column, np.arange(256, dtype=np.uint8), np.arange(256) == 32)
    want = [(i, w.encode()) for i, text in enumerate(texts) for w in (text or "").split()]
    owner = np.repeat(np.arange(len(texts)), np.diff(found.firsts))
    assert [(o, found.word(i)) for i, o in enumerate(owner)] == want
    by_word = {}
    for (_, word), value in zip(want, found.hashes.tolist()):
        assert by_word.setdefault(word, value) == value
    assert len(set(by_word.values())) == len(by_word)


def test_common_counts(monkeypatch):
    monkeypatch.setattr(ngram_join, "ENTRIES", 300)
    make = np.random.default_rng(2)
    sets = [np.unique(make.integers(0, 300, 150)).astype(np.uint64) << np.uint64(55) for _ in range(9)]
    found = ngram_join.common_counts(sets)
    assert all(found[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(9) for j in range(9))


def brute_phrases(rows, least, covered, top):
    counts, n = defaultdict(Counter), Counter()
    for row in rows:
        lang = row[2] or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (row[1] or "").translate(LOW)):
            words = [w for w in re.split("[\x20\x09]", piece) if w]
            n[lang] += len(words)
            counts[lang].update(" ".join(words[i : i + k]) for k in range(1, 6) for i in range(len(words) - k + 1))
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if a >= least and " " in p}
        ranked = []
        for phrase, a in candidates.items():
            if any(len(q) > len(phrase) and f" {phrase} " in f" {q} " and 100 * c >= covered * a for q, c in candidates.items()):
                continue
            words = phrase.split(" ")
            cuts = []
            for k in range(1, len(words)):
                left, right = f[" ".join(words[:k])], f[" ".join(words[k:])]
                cuts.append((1000 * a * n[lang] // (left * right), k, left, right))
            score, _, left, right = min(cuts)
            ranked.append((-score, -a, phrase.encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(ranked)[:top], 1):
            yield lang, rank, phrase.decode(), -a, left, right, n[lang], -score


def phrase_rows(seed=4):
    make = random.Random(seed)
    words = ["a", "B", "c\x00", "é", "dd", "\x1c", "f-g", "H"]
    ends = [" ", "  ", "\t", ". ", ",", "\n", "!? ", "\x0b"]
    text = lambda n: "".join(make.choice(words) + make.choice(ends[:3] * 4 + ends) for _ in range(n))
    rows = [(i, text(make.randrange(60)), make.choice(["en", "de", None]), "s", 1) for i in range(150)]
    rows += [(i, "one passage that is found in one text of the sample only " * 9, "en", "s", 1) for i in range(200, 204)]
    return rows + [(1, None, "en", "s", 1), (2, "", "fr", "s", 1), (3, "a " * 50_000, "und", None, None), rows[5], rows[5], (None, "A b", None, "s", 1)]


@pytest.mark.parametrize("least,covered,slack", [(5, 100, 2.0), (30, 70, 2.0), (20, 100, -6.0)])
def test_phrases(spark, monkeypatch, least, covered, slack):
    monkeypatch.setattr(phrase_mining, "SLACK", slack)  # a negative one proposes too little: the border fails
    for name, value in {"HELD": 300, "HELD_TEXTS": 50, "EMITTED": 40}.items():
        monkeypatch.setattr(phrase_mining, name, value)
    monkeypatch.setattr(common, "SLICE_BYTES", 900)
    rows = phrase_rows()
    found = [tuple(r) for r in phrase_mining.collocations(table_of(spark, rows), least, covered, 40).collect()]
    want = sorted(brute_phrases(rows, least, covered, 40))
    assert want and sorted(found) == want


def test_a_failed_border_brings_further_passes(spark, monkeypatch):
    monkeypatch.setattr(phrase_mining, "SLACK", -1000.0)
    assert phrase_mining.frequent_hashes(table_of(spark, phrase_rows()), 20)[3] > 1


def test_phrases_of_nothing(spark):
    assert phrase_mining.collocations(table_of(spark, phrase_rows()).where("doc_id = -1")).count() == 0
    assert phrase_mining.collocations(table_of(spark, phrase_rows()), least=10**9).count() == 0


def test_scores_beyond_64_bits(spark):
    frequent = spark.createDataFrame(
        [("en", "a", 1, 3_000_000_007), ("en", "b", 1, 4_000_000_009), ("en", "a b", 2, 2_900_000_003)], "lang string, phrase string, length int, f long"
    )
    totals = spark.createDataFrame([("en", 9_007_199_254_740_993)], "lang string, n long")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(phrase_mining, "frequent_phrases", lambda *_: (frequent, totals))
        row = phrase_mining.collocations(None).first()
    assert row["score"] == 1000 * 2_900_000_003 * 9_007_199_254_740_993 // (3_000_000_007 * 4_000_000_009)


@pytest.mark.parametrize("name", ["op9_setsketch", "op11_ngram_join", "op12_merkle_manifest", "op13_phrase_mining"])
def test_equals_sql(spark, sf, name):
    import oracle
    from reviewlens.llm import queries

    # no phrase need be frequent at the smallest scale
    assert oracle.compare(queries.QUERIES[name](spark, sf), queries.ORACLE_SQL[name], oracle.connect(sf)) in ("", "no rows")


def test_phrase_counts_are_dealt_before_spark_adds_them(spark):
    from reviewlens.llm import phrase_mining
    from reviewlens.llm.common import BitTable

    documents = spark.createDataFrame([(i, "a b c d", "en") for i in range(8)], "doc_id long, text string, lang string")
    table = spark.sparkContext.broadcast(BitTable.empty(phrase_mining.LEAST_BITS))
    counted = phrase_mining._counted(documents, table, 1)
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan and "HashAggregate" not in plan.split("REPARTITION_BY_COL")[-1]
    found = [(r["lang"], r["count"]) for r in counted.collect()]
    assert sorted(found, key=str) == [("en", 32), (None, 8), (None, 8), (None, 8), (None, 8)]


def test_rows_of_the_last_pass_do_not_grow_with_partitions(spark):
    rows = [(i, "one two three", "en") for i in range(120)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(60)
    tasks = phrase_mining.TASKS_A_CORE * spark.sparkContext.defaultParallelism
    assert phrase_mining._in_few_tasks(phrase_mining._texts(documents)).rdd.getNumPartitions() <= tasks < 60
    found, _ = phrase_mining.frequent_phrases(documents, 100)
    assert {r["phrase"]: r["f"] for r in found.collect()} == {
        p: 120 for p in ("one", "two", "three", "one two", "two three", "one two three")
    }
