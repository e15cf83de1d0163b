"""Row-wise operators against brute force and the libraries, with hard inputs."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

from reviewlens.llm import decontaminate, language_mixture, license_scan, packing, token_counts, warc_derivatives

LOW = str.maketrans({chr(a): chr(a + 32) for a in range(65, 91)})
CLASHING = "doc_id long, text string, lang string, source string, n_words long, hits int, _row int, items string"
ALPHABET = "abcdefgh ABC  \n\t.,!?'’0123éÉñçßΣσςİıǅǺ̈你好かカ한가ก็🙂👩‍👩‍👧  \x1c\x1f\x85​ﬁﬀ½²"


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def hard_documents(spark, texts):
    rows = [(i, t, "en", "s", 9, 9, 9, "x") for i, t in enumerate(texts)]
    rows += [(None, "a null id", None, None, None, None, None, None), rows[0]]
    return spark.createDataFrame(rows, CLASHING)


def random_texts(n, seed=1):
    make = random.Random(seed)
    texts = ["".join(make.choice(ALPHABET) for _ in range(make.randint(0, 50))) for _ in range(n)]
    return [None, "", " ", "\n", *texts, "it's THEY'RE we'd <|endoftext|> <|startoftext|>x", "word " * 30_000]


def brute_decontamination(text, items):
    words, hit, found = words_of(text), set(), set()
    for item, content in items:
        parts = words_of(content)
        if not parts:
            continue
        size = min(10, len(parts))
        windows = {tuple(parts[i : i + size]) for i in range(len(parts) - size + 1)}
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in windows:
                hit.update(range(i, i + size))
                if item is not None:
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("part", [400_000, 3])
def test_decontamination(spark, part):
    item = "One two three, four five six seven eight nine ten eleven twelve"
    items = [(1, item), (1, item), (10, "Short one"), (2, None), (None, "a null id"), (3, "!!"), (4, "é à Ü 99")]
    texts = ["x " + item.upper() + " y", "one two three four five six seven eight nine tenth", "SHORT--one short one", "É à ü 99 é à Ü 99.", "x" * 100_000, None, "", *random_texts(40)]
    docs = hard_documents(spark, texts)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.scan(docs, benchmark, automaton_windows=part).collect()
    assert len(rows) == len(texts) + 2
    for row in rows:
        text = "a null id" if row["doc_id"] is None else texts[row["doc_id"]]
        n, hit, found = brute_decontamination(text, items)
        assert (row["n_words"], row["n_hit"], row["items"]) == (n, hit, found)
        assert sum(s["last_word"] - s["first_word"] + 1 for s in row["spans"]) == hit
        for span in row["spans"]:
            assert words_of(text[span["start"] : span["end"]]) == words_of(text)[span["first_word"] : span["last_word"] + 1]
    kept = decontaminate.remove_contaminated(docs, benchmark, automaton_windows=part)
    assert kept.columns == docs.columns
    clean = sorted(str(r["doc_id"]) for r in rows if not r["n_hit"])
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == clean
    digest = {r["doc_id"]: r for r in decontaminate.digest(decontaminate.scan(docs, benchmark)).collect()}
    assert digest[0]["items_sha256"] == hashlib.sha256(b"1").hexdigest() and digest[0]["contaminated"]
    nothing = decontaminate.scan(docs, benchmark.limit(0)).where("n_hit > 0").count()
    assert nothing == 0 and decontaminate.scan(docs.limit(0), benchmark).count() == 0


def test_token_counts(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library, texts = tokenizers.Tokenizer.from_file(path), random_texts(400)
    rows = token_counts.count_tokens(hard_documents(spark, texts), path).collect()
    assert len(rows) == len(texts) + 2
    for row in rows:
        text = "a null id" if row["doc_id"] is None else texts[row["doc_id"]] or ""
        expected = len(library.encode(text, add_special_tokens=False).ids)
        assert (row["n_bytes"], row["n_tokens"], row["over_limit"]) == (len(text.encode()), expected, expected > 2048)
    assert token_counts.count_tokens(hard_documents(spark, [""]).limit(0), path).count() == 0


def test_packing(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, texts = tokenizers.Tokenizer.from_file(path), random_texts(400)
    docs = hard_documents(spark, texts).where("doc_id > 0 OR doc_id IS NULL")
    rows = packing.pack(docs, path, public_tokenizers.PATTERN, pool=100).collect()
    pieces, sequences = {}, {}
    for row in rows:
        pieces.setdefault(row["doc_id"], []).append(row)
        sequences.setdefault(row["sequence_id"], []).append(row)
    assert len(pieces) == len(texts)
    for doc_id, own in pieces.items():
        text = "a null id" if doc_id is None else texts[doc_id] or ""
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for row in sorted(own, key=lambda r: r["start"]):
            assert row["start"] == at and row["doc_tokens"] == len(ids)
            assert row["ids_crc32"] == zlib.crc32(ids[at : at + row["length"]].tobytes())
            at += row["length"]
        assert at == len(ids)
    padding = 0
    for own in sequences.values():
        at = 0
        for row in sorted(own, key=lambda r: r["offset"]):
            assert row["offset"] == at
            at += row["length"]
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding <= 0.01 * 1024 * len(sequences)
    assert packing.pack(docs.limit(0), path, public_tokenizers.PATTERN).count() == 0


def test_best_fit_is_tightest():
    lengths = [700, 600, 400, 330, 300, 300]
    windows = packing.best_fit(lengths, 1000)
    assert sorted(sorted(lengths[i] for i in w) for w in windows) == [[300, 330], [300, 700], [400, 600]]


def test_licences(spark):
    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy"
    broken = notice.replace("hereby", "herby").replace("charge", "chage").lower()
    texts = [
        None, "", "MIT License and the Apache-License; mit license", "cc-by", broken, "x " * 20_000 + notice,
        "all right reserved", "GNU  General Public LICENSE", "admit license", *random_texts(30),
    ]
    rows = license_scan.digest(license_scan.scan(hard_documents(spark, texts))).collect()
    assert len(rows) == len(texts) + 2
    by_id = {r["doc_id"]: r for r in rows}
    for row in rows:
        words = words_of("a null id" if row["doc_id"] is None else texts[row["doc_id"]])
        places, labels = [], set()
        for phrase, label in license_scan.PHRASES.items():
            parts = phrase.split()
            at = [i for i in range(len(words)) if words[i : i + len(parts)] == parts]
            places += at
            labels |= {label} if at else set()
        assert (row["n_words"], row["n_base"], row["first_word"], row["last_word"]) == (
            len(words), len(places), min(places, default=None), max(places, default=None))
        assert row["base_labels"] == ",".join(sorted(labels)) and labels <= set(row["labels"].split(","))
        assert 0 <= row["score"] <= 1
    assert by_id[4]["labels"] == "mit" and by_id[4]["findings"][0]["edits"] == 2
    found = by_id[5]["findings"][0]
    assert texts[5][found["start"] : found["end"]] == notice and found["edits"] == 0
    assert by_id[6]["labels"] == "all-rights-reserved" and by_id[8]["labels"] == ""
    assert license_scan.scan(hard_documents(spark, [""]).limit(0)).count() == 0


def test_language_mixture(spark):
    en, de = "the house and the river with that thing of ours ", "das haus und der fluss mit diesem ding von uns "
    texts = [en * 3, de * 3] * 10 + [None, "", "12 34 !!", "x", en * 8 + de * 2, "ß" * 50_000]
    rows = [(i, t, ["en", "de"][i % 2] if i < 20 else None, 1) for i, t in enumerate(texts)] + [(None, en, "en", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, shares int")
    model = language_mixture.train(docs)
    found = {r["doc_id"]: r for r in language_mixture.predict(docs, model).collect()}
    assert len(found) == len(rows)
    assert all(found[i]["lang_pred"] == ["en", "de"][i % 2] and found[i]["score"] == 1 for i in range(20))
    assert [found[i]["lang_pred"] for i in (20, 21, 22)] == ["und"] * 3
    mixed = found[24]["shares"]
    assert found[24]["lang_pred"] == "en" and abs(mixed["en"] - 0.8) < 0.05 and abs(sum(mixed.values()) - 1) < 1e-6
    kept = language_mixture.identified(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id IN (20, 21, 22)").count() == 0
    nothing = language_mixture.train(docs.where("lang IS NULL"))
    assert {r["lang_pred"] for r in language_mixture.predict(docs, nothing).collect()} == {"und"}


def test_language_held_out(spark, sf):
    from reviewlens.llm.queries import op2_language_mixture

    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    held = op2_language_mixture(spark, sf).where("held_out").join(truth, "doc_id")
    right = held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.9


def test_warc_round_trip(spark, tmp_path):
    page = "<html lang='fr'><head><title>A &amp; b</title></head><body><p>One<br>two</p><script>x</script><a href='/y?a=1&amp;b=2'>go</a></body>"
    rows = [(1, "http://a/x", page, 5), (1, "http://a/x", page, 5), (2, None, None, 5), (None, "u", "<p>bro<ken", 5), (3, "v", "é" * 70_000, 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, block int")
    sources = warc_derivatives.responses(pages).collect()
    made = warc_derivatives.derivatives(warc_derivatives.responses(pages)).collect()
    assert len(sources) == 5 and len(made) == 10
    by_id = {r["record_id"]: r for r in sources}
    for row in made:
        source = by_id[row["refers_to"]]
        block = bytes(row["block"])
        assert row["target_uri"] == source["target_uri"] and row["warc_date"] == source["warc_date"]
        assert row["block_digest"] == warc_derivatives.digest(block) and row["content_length"] == len(block)
        if row["warc_type"] == "metadata":
            fields = block.decode()
            assert source["block_digest"] in fields and source["payload_digest"] in fields and source["record_id"] in fields
    first = {r["warc_type"]: bytes(r["block"]).decode() for r in made if r["page_id"] == 1}
    assert first["conversion"] == "One\ntwo\ngo"
    assert "title: A & b\r\n" in first["metadata"] and "outlink: /y?a=1&b=2\r\n" in first["metadata"] and "language: fr\r\n" in first["metadata"]
    file = b"".join(warc_derivatives.serialise({**r.asDict(), "block": bytes(r["block"])}) for r in [*sources, *made])
    (tmp_path / "x.warc.gz").write_bytes(file)
    back = warc_derivatives.read_warc(spark, str(tmp_path / "x.warc.gz")).collect()
    same = lambda rs: [(r["record_id"], r["warc_type"], r["refers_to"], r["block_digest"], dict(r["headers"]), bytes(r["block"])) for r in rs]
    assert same(back) == same([*sources, *made])
    assert warc_derivatives.derivatives(warc_derivatives.responses(pages.limit(0))).count() == 0
