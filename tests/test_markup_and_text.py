import random
import re
import time

from pyspark.sql import functions as F

from reviewlens import settings
from reviewlens.functions import markup, text
from reviewlens.operators import lemmas

CASES = {
    "[h1]Great Game![/h1] [b]Highly recommended![/b]": "Great Game! Highly recommended!",
    "[quote]Best game ever[/quote] [url=steam://]Check it out[/url]": "Best game ever Check it out",
    "[spoiler]Secret ending is amazing[/spoiler]": "Secret ending is amazing",
    "[b][b]x[/b][/b]": "[b]x[/b]",
    "[list][*]a[*]b[/list] z": "ab z",
    "x[table]y[/table]z": "x z",
}


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "t string").select(expr.alias("r")).head()["r"]


def test_known_cases(spark):
    for raw, want in CASES.items():
        assert one(spark, markup.clean_markup(F.col("t")), raw) == want
    assert one(spark, markup.clean_markup(F.col("t")), None) == ""


def test_usage(spark):
    df = spark.createDataFrame([(t,) for t in list(CASES)[:3]], "review string")
    used = {r["tag"]: r["n"] for r in markup.markup_usage(df).collect()}
    assert {t for t, n in used.items() if n} == {"headers", "bold", "quote", "url_with_text", "spoiler"}
    assert all(n in (0, 1) for n in used.values()) and len(used) == 18


def random_texts(n):
    rng = random.Random(5)
    names = ["h1", "H3", "b", "i", "u", "s", "url", "img", "quote", "list", "spoiler", "code", "noparse", "table", "emoticon"]
    pieces = [f"[{n}]" for n in names] + [f"[/{n}]" for n in names] + [
        "[url=a b]", "[size=2]", "[/size]", "[color=red]", "[/color]", "[*]", "x", "Y z", " ", "\n", " ", "$1", "\\", "é",
    ]
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 14))) for _ in range(n)]


def test_rules_equal_python_regex(spark):
    texts = random_texts(1500)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {
        r["i"]: (r["keep"], r["drop"])
        for r in df.select("i", markup.clean_markup(F.col("t")).alias("keep"), markup.clean_markup(F.col("t"), False).alias("drop")).collect()
    }
    flags = re.IGNORECASE | re.DOTALL
    for i, raw in enumerate(texts):
        keep = drop = raw
        for _, pattern, repl in markup.MARKUP_RULES:
            keep = re.sub(pattern, repl.replace("$1", r"\1"), keep, flags=flags)
            drop = re.sub(pattern, "", drop, flags=flags)
        squeeze = lambda s: re.sub(r"\s+", " ", s).strip()
        assert got[i] == (squeeze(keep), squeeze(drop)), raw


def test_field_fallback(spark):
    df = spark.createDataFrame([(None, "[b]t[/b]"), ("r", "x"), (None, None)], "review string, text string")
    assert [r["cleaned"] for r in markup.clean_reviews(df).collect()] == ["t", "r", ""]
    only_text = spark.createDataFrame([("a",)], "text string")
    assert markup.clean_reviews(only_text).head()["cleaned"] == "a"


def test_sentences(spark):
    df = spark.createDataFrame([(1, "Hi! You? ok."), (2, None), (3, "  \n ")], "id int, review string")
    rows = text.review_sentences(df, "review", ["id"]).orderBy("id", "sent_pos").collect()
    assert [r["sentence"] for r in rows] == ["Hi!", "You?", "ok."]


def test_token_rules(spark):
    ascii_tokens = text.tokens(text.normalize_ascii(F.col("t")), settings.FIXED_STOP_WORDS)
    assert one(spark, ascii_tokens, "I don't see https://x.y/z the CLASSES, bosses and 2 cities") == ["dont", "class", "boss", "city"]
    assert one(spark, ascii_tokens, None) == []
    grams = text.ngrams(F.split("t", " "))
    assert one(spark, grams, "a b c") == ["a", "b", "c", "a b", "b c"]
    assert one(spark, grams, "a") == ["a"]


def test_lemma_endings(spark):
    words = {"cities": "city", "churches": "church", "wolves": "wolf", "boxes": "box", "women": "woman", "boss": "boss", "graphics": "graphic", "run": "run"}
    for word, want in words.items():
        assert one(spark, text.lemma(F.col("t")), word) == want


def test_attested_lemmas(spark):
    plural = {
        "movies": "movie", "series": "series", "zombies": "zombie", "waves": "wave", "moves": "move", "lives": "life",
        "uses": "use", "houses": "house", "always": "always", "focus": "focus", "cities": "city", "boxes": "box",
        "wolves": "wolf", "women": "woman", "boss": "boss", "bosses": "boss", "gas": "gas", "leaves": "leaf", "saves": "save",
    }
    singular = [*plural.values(), "live", "us", "ga", "leave", "safe", "bus"]
    rows = [(1, list(plural)), (2, singular), (3, ["always"] * 300 + ["alway"]), (4, None)]
    docs = spark.createDataFrame(rows, "id int, tokens array<string>")
    table = {r["word"]: r["lemma"] for r in lemmas.attested_lemmas(docs.select(F.explode("tokens").alias("word"))).collect()}
    assert {w: table[w] for w in plural} == plural
    assert all(table[w] == w for w in singular)
    found = {r["id"]: r["tokens"] for r in lemmas.with_attested_lemmas(docs, ["id"]).collect()}
    assert found[1] == list(plural.values()) and found[3] == rows[2][1] and 4 not in found


def test_attested_lemmas_in_place_and_by_join(spark):
    rows = [(i, ["movies", "movie", None, "wolf"] + ["wolves"] * (i % 3)) for i in range(30)] + [(30, []), (31, None)]
    docs = spark.createDataFrame(rows, "id long, tokens array<string>").repartition(3)
    want = {i: ["movie", "movie", None, "wolf"] + ["wolf"] * (i % 3) for i in range(30)}
    for most in (100, 0):
        found = lemmas.with_attested_lemmas(docs, ["id"], max_rows=most)
        assert {r["id"]: r["tokens"] for r in found.collect()} == want
    plan = lemmas.with_attested_lemmas(docs, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "SortMergeJoin" not in plan  # the lists never leave their rows


def test_unclosed_marks_take_one_search(spark):
    raw = "[b]" * 100_000 + "[url=" * 20_000 + "end"
    begun = time.time()
    assert one(spark, markup.clean_markup(F.col("t")), raw) == raw
    assert time.time() - begun < 20


def test_space_of_cleaning_is_that_of_the_pattern(spark):
    chars = [chr(i) for i in [*range(0xD800), *range(0xE000, 0x110000)]]
    texts = ["a" + c + "a" for c in chars]
    df = spark.createDataFrame([("".join(texts[i : i + 4096]),) for i in range(0, len(texts), 4096)], "t string")
    assert df.where(markup.clean_markup(F.col("t")) != markup.collapse_space(F.col("t"))).count() == 0
