"""Markup cleaning, sentences, normalisation and tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlens import settings
from reviewlens.catalog import sql_text
from reviewlens.catalog.registry import query, sql_list, texts
from reviewlens.functions import markup, text
from reviewlens.operators import class_tfidf, lemmas, topic_words

# The test texts hold no markup, so the query wraps every whole text in it.
MARKED_PARTS = (
    ("[H1]", "lang"), ("[/h2] [b][i]", "text"), ("[/I][/B] [u]", "source"), ("[/u][s]", "lang"),
    ("[/s] [url=http://", "source"), ("]", "lang"), ("[/url][url]", "source"),
    ("[/url] [img]", "source"), ("[/img][quote]", "text"), ("[/quote] [list][*]", "source"), ("[*]", "lang"),
    ("[/list] [size=3]", "lang"), ("[/size][color=red]", "source"), ("[/color] [spoiler]", "text"),
    ("[/spoiler] [code]", "lang"), ("[/code] [noparse][b]", "lang"), ("[/noparse] a[table]", "source"),
    ("[/table]b[emoticon]", "lang"), ("[/emoticon] [b][b]", "source"), ("[/b][/b] [quote=", "lang"), ("]", None),
)


def marked_text():
    pieces = []
    for literal, column in MARKED_PARTS:
        pieces.append(F.lit(literal))
        if column:
            pieces.append(F.col(column))
    return F.concat(*pieces)


def _marked_sql() -> str:
    parts = []
    for literal, column in MARKED_PARTS:
        parts.append(f"'{literal}'")
        if column:
            parts.append(column)
    return " || ".join(parts)


MARKED_SQL = _marked_sql()


def _marked_docs(spark, sf):
    return texts(spark, sf).select("doc_id", marked_text().alias("review"))


@query(f"SELECT doc_id, md5({sql_text.clean(MARKED_SQL)}) AS digest, length({sql_text.clean(MARKED_SQL)}) AS n FROM documents")
def markup_clean(spark, sf):
    cleaned = markup.clean_reviews(_marked_docs(spark, sf))
    return cleaned.select("doc_id", F.md5("cleaned").alias("digest"), F.length("cleaned").cast("long").alias("n"))


# Without content, the two bullets go with the enclosing list, which is removed first.
@query(f"SELECT doc_id, {sql_text.clean(MARKED_SQL, keep_content=False)} AS cleaned FROM documents")
def markup_strip(spark, sf):
    return markup.clean_reviews(_marked_docs(spark, sf), keep_content=False).select("doc_id", "cleaned")


def _usage_sql() -> str:
    parts = []
    for name, pattern, _ in markup.MARKUP_RULES:
        count = (
            "(length(t) - length(replace(t, '[*]', ''))) // 3" if name == "list_item"
            else f"len(regexp_extract_all(t, '{markup.FLAGS}{pattern}'))"
        )
        parts.append(f"SELECT '{name}' AS tag, CAST(sum({count}) AS BIGINT) AS n FROM marked")
    return f"WITH marked AS (SELECT {MARKED_SQL} AS t FROM documents) " + " UNION ALL ".join(parts)


@query(_usage_sql())
def markup_usage(spark, sf):
    return markup.markup_usage(_marked_docs(spark, sf))


def _rule_query(rule: str):
    pattern, repl = {n: (p, r) for n, p, r in markup.MARKUP_RULES}[rule]
    target = repl.replace("$1", r"\1")
    if rule == "list_item":
        expr = f"replace({MARKED_SQL}, '[*]', '')"
    else:
        expr = f"regexp_replace({MARKED_SQL}, '{markup.FLAGS}{pattern}', '{target}', 'g')"

    def run(spark, sf):
        return _marked_docs(spark, sf).select("doc_id", F.md5(markup.apply_rule(F.col("review"), rule)).alias("digest"))

    query(f"SELECT doc_id, md5({expr}) AS digest FROM documents", name=f"markup_rule_{rule}")(run)


for _rule, _, _ in markup.MARKUP_RULES:
    _rule_query(_rule)


@query(f"SELECT doc_id, md5({sql_text.collapse('text')}) AS digest FROM documents")
def whitespace_collapse(spark, sf):
    return texts(spark, sf).select("doc_id", F.md5(markup.collapse_space(F.col("text"))).alias("digest"))


@query(sql_text.sentences("documents", "text", "doc_id"))
def sentences(spark, sf):
    return text.review_sentences(texts(spark, sf), "text", ["doc_id"], markup=False)


@query(sql_text.sentences(f"(SELECT doc_id, {sql_text.clean(MARKED_SQL)} AS text FROM documents)", "text", "doc_id"))
def sentences_after_markup(spark, sf):
    return text.review_sentences(_marked_docs(spark, sf), "review", ["doc_id"])


@query(sql_text.sentences("(SELECT doc_id, lower(text) AS text FROM documents)", "text", "doc_id"))
def sentences_lower(spark, sf):
    return text.explode_sentences(texts(spark, sf), "text", ["doc_id"], lower=True)


@query("SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents")
def newline_split(spark, sf):
    return texts(spark, sf).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))


@query(f"""
WITH s AS ({sql_text.sentences("documents", "text", "doc_id")})
SELECT (SELECT count(*) FROM documents) AS reviews, count(*) AS sentences FROM s""")
def sentence_counts(spark, sf):
    docs = texts(spark, sf)
    found = text.review_sentences(docs, "text", ["doc_id"], markup=False)
    return found.agg(F.count(F.lit(1)).alias("sentences")).select(
        docs.agg(F.count(F.lit(1)).alias("n")).scalar().alias("reviews"), "sentences"
    )


@query("SELECT doc_id, md5(lower(text)) AS digest FROM documents")
def lower_case(spark, sf):
    return texts(spark, sf).select("doc_id", F.md5(F.lower("text")).alias("digest"))


@query(f"SELECT page_id, {sql_text.unicode_norm('html')} AS normal FROM pages")
def normalize_unicode(spark, sf):
    return texts(spark, sf, "pages").select("page_id", text.normalize_unicode(F.col("html")).alias("normal"))


@query(f"SELECT page_id, regexp_replace(lower(html), '{text.URL}', '', 'g') AS bare FROM pages")
def strip_urls(spark, sf):
    return texts(spark, sf, "pages").select("page_id", F.regexp_replace(F.lower("html"), text.URL, "").alias("bare"))


@query(f"SELECT page_id, {sql_text.ascii_norm('html')} AS normal FROM pages")
def normalize_ascii(spark, sf):
    return texts(spark, sf, "pages").select("page_id", text.normalize_ascii(F.col("html")).alias("normal"))


@query(f"SELECT doc_id, {sql_text.words(sql_text.unicode_norm('text'))} AS words FROM documents")
def word_tokens(spark, sf):
    return texts(spark, sf).select("doc_id", text.words(text.normalize_unicode(F.col("text"))).alias("words"))


@query(f"""
SELECT doc_id, list_filter({sql_text.words(sql_text.unicode_norm('text'))},
  lambda w: length(w) > 2 AND w NOT IN ({sql_list(settings.TOPIC_STOP_WORDS)})) AS kept FROM documents""")
def stop_words_and_length(spark, sf):
    tokens = text.tokens(text.normalize_unicode(F.col("text")), settings.TOPIC_STOP_WORDS, lemmatize=False)
    return texts(spark, sf).select("doc_id", tokens.alias("kept"))


@query(f"""
WITH w AS (SELECT doc_id, unnest({sql_text.words(sql_text.unicode_norm('text'))}) AS word FROM documents)
SELECT doc_id, word FROM w ANTI JOIN (SELECT unnest([{sql_list(settings.STUDY_STOP_WORDS)}]) AS word) s USING (word)""")
def stop_words_anti_join(spark, sf):
    exploded = texts(spark, sf).select(
        "doc_id", F.explode(text.words(text.normalize_unicode(F.col("text")))).alias("word")
    )
    stop = spark.createDataFrame([(w,) for w in settings.STUDY_STOP_WORDS], "word string")
    # the list is a fixed value of under 250 words
    return exploded.join(F.broadcast(stop), "word", "left_anti").select("doc_id", "word")


@query(f"""
WITH w AS (SELECT DISTINCT unnest({sql_text.words(sql_text.unicode_norm('text'))}) AS word FROM documents)
SELECT word, {sql_text.lemma('word')} AS lemma FROM w""")
def lemmatize(spark, sf):
    words = texts(spark, sf).select(F.explode(text.words(text.normalize_unicode(F.col("text")))).alias("word"))
    return words.distinct().select("word", text.lemma(F.col("word")).alias("lemma"))


ATTESTED_SQL = f"""
WITH w AS (SELECT doc_id, unnest({sql_text.words(sql_text.unicode_norm('text'))}) AS word FROM documents),
counts AS (SELECT word, count(*) AS n FROM w GROUP BY word),
rules AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{e}', '{r}')" for i, (e, r) in enumerate(lemmas.ATTESTED_ENDINGS))}) t(rank, ending, repl)),
forms AS (SELECT c.word, c.n, r.rank, left(c.word, length(c.word) - length(r.ending)) || r.repl AS form
          FROM counts c JOIN rules r ON ends_with(c.word, r.ending) WHERE NOT (r.ending = 's' AND ends_with(c.word, 'ss'))),
chosen AS (SELECT f.word, arg_min(f.form, f.rank) AS form FROM forms f JOIN counts k ON k.word = f.form
           WHERE length(f.form) >= {lemmas.SHORTEST_FORM} AND k.n * {lemmas.RARER} >= f.n GROUP BY f.word)"""


@query(f"""{ATTESTED_SQL}
SELECT counts.word, coalesce(form, counts.word) AS lemma FROM counts LEFT JOIN chosen ON counts.word = chosen.word""")
def attested_lemmas(spark, sf):
    words = texts(spark, sf).select(F.explode(text.words(text.normalize_unicode(F.col("text")))).alias("word"))
    return lemmas.attested_lemmas(words)


@query(f"""{ATTESTED_SQL}
SELECT doc_id, coalesce(form, w.word) AS lemma, count(*) AS n FROM w LEFT JOIN chosen ON w.word = chosen.word
GROUP BY doc_id, coalesce(form, w.word)""")
def attested_lemma_counts(spark, sf):
    tokenised = texts(spark, sf).select("doc_id", text.words(text.normalize_unicode(F.col("text"))).alias("tokens"))
    found = lemmas.with_attested_lemmas(tokenised, ["doc_id"])
    return found.select("doc_id", F.explode("tokens").alias("lemma")).groupBy("doc_id", "lemma").agg(F.count("*").alias("n"))


@query(f"""
WITH w AS (SELECT doc_id, unnest({sql_text.words(sql_text.unicode_norm('text'))}) AS word FROM documents),
known AS (SELECT DISTINCT unnest({sql_text.words(sql_text.unicode_norm('text'))}) AS word FROM benchmark)
SELECT doc_id, word, CASE WHEN known.word IS NOT NULL THEN 'known:' || word ELSE {sql_text.lemma('word')} END AS lemma
FROM w LEFT JOIN known USING (word)""")
def lemmatize_by_table(spark, sf):
    def words(name, *keys):
        return texts(spark, sf, name).select(*keys, F.explode(text.words(text.normalize_unicode(F.col("text")))).alias("word"))

    lemmas = words("benchmark").distinct().withColumn("lemma", F.concat(F.lit("known:"), "word"))
    return text.lemmatize_by_table(words("documents", "doc_id"), "word", lemmas, ["doc_id"])


@query(f"WITH {sql_text.study_docs()} SELECT doc_id, sent_pos, array_to_string(tokens, ' ') AS processed FROM study")
def study_sentences(spark, sf):
    return text.study_sentences(texts(spark, sf), "text", ["doc_id"]).select("doc_id", "sent_pos", "processed")


@query(f"WITH {sql_text.fixed_docs()} SELECT doc_id, tokens FROM fixed")
def fixed_tokens(spark, sf):
    return text.fixed_tokens(texts(spark, sf), "text", ["doc_id"])


@query(f"""
WITH {sql_text.fixed_docs()}
SELECT doc_id, tokens || list_transform(range(1, len(tokens)), lambda i: tokens[i] || ' ' || tokens[i + 1]) AS grams FROM fixed""")
def ngrams(spark, sf):
    tokenised = text.fixed_tokens(texts(spark, sf), "text", ["doc_id"])
    return tokenised.select("doc_id", text.ngrams(F.col("tokens")).alias("grams"))


@query(f"""
WITH s AS ({sql_text.sentences(f"(SELECT doc_id, source, {sql_text.clean('text')} AS text FROM documents)", "text", "doc_id, source")}),
t AS (SELECT source, unnest({sql_text.tokens(sql_text.unicode_norm('sentence'), settings.STUDY_STOP_WORDS)}) AS term FROM s),
c AS (SELECT source AS topic, term, count(*) AS tf FROM t GROUP BY ALL),
z AS (SELECT topic, sum(tf) AS topic_words FROM c GROUP BY topic),
f AS (SELECT term, sum(tf) AS f FROM c GROUP BY term),
w AS (SELECT topic, term, tf / topic_words * ln(1 + (SELECT floor(avg(topic_words)) FROM z) / f) AS weight
      FROM c JOIN z USING (topic) JOIN f USING (term)),
r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term) AS rank FROM w)
SELECT topic AS source, CAST(rank AS INTEGER) AS rank, term, round(weight, 9) AS weight FROM r WHERE rank <= 10""")
def top_words_per_source(spark, sf):
    found = text.review_sentences(texts(spark, sf), "text", ["doc_id", "source"])
    tokens = text.tokens(text.normalize_unicode(F.col("sentence")), settings.STUDY_STOP_WORDS)
    counts = class_tfidf.class_term_counts(text.evaluated_once(found, ["source"], tokens, "tokens"), "source")
    weights = class_tfidf.class_tfidf(counts)
    return topic_words.top_words(weights).select(
        F.col("topic").alias("source"), "rank", "term", F.round("weight", 9).alias("weight")
    )
