"""Sentiment, names, reports, topic models and whole analyses."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlens import settings
from reviewlens.catalog import sql_text
from reviewlens.catalog.registry import query, sql_list, table, texts
from reviewlens.catalog.vector_queries import DETAILS_SQL, CLASS_SQL, _details, fixed_docs, source_weights, study_docs
from reviewlens.functions import formatting, text
from reviewlens.operators import assignment, class_tfidf, density, embedding, naming, reports, sentiment, topic_words
from reviewlens.operators.topic_model import first_max_topics, topic_export
from reviewlens.plans import fixed_study, review_analysis, topic_study

# --- sentiment -------------------------------------------------------------------

SCORED_SQL = f"""
sents AS ({sql_text.sentences("documents", "text", "doc_id, source")}),
balance AS (
  SELECT doc_id, source, sent_pos, sentence, CAST(
     len(list_filter(words, lambda w: w IN ({sql_list(settings.POSITIVE_WORDS)})))
   - len(list_filter(words, lambda w: w IN ({sql_list(settings.NEGATIVE_WORDS)}))) AS INTEGER) AS b
  FROM (SELECT *, {sql_text.words(sql_text.unicode_norm('sentence'))} AS words FROM sents)),
scored AS (SELECT *, CASE WHEN b < 0 THEN 'NEGATIVE' ELSE 'POSITIVE' END AS label,
                  (1.0::DOUBLE + abs(b)) / (2.0::DOUBLE + abs(b)) AS score FROM balance)"""


def _sentences(spark, sf, *keys):
    return text.review_sentences(texts(spark, sf), "text", ["doc_id", *keys], markup=False)


def _scored(spark, sf):
    return sentiment.lexicon_sentiment(_sentences(spark, sf, "source"))


@query(f"WITH {SCORED_SQL} SELECT doc_id, sent_pos, label, round(score, 9) AS score FROM scored")
def sentiment_lexicon(spark, sf):
    return _scored(spark, sf).select("doc_id", "sent_pos", "label", F.round("score", 9).alias("score"))


TOPIC_SENTIMENT_SQL = f"""{SCORED_SQL},
table5 AS (SELECT source AS topic, round(avg(CASE label WHEN 'POSITIVE' THEN 1 ELSE -1 END), 7) AS sentiment_mean,
   count(*) AS sentence_count, round(avg(score), 7) AS confidence_mean, round(stddev_samp(score), 7) AS confidence_std
 FROM scored GROUP BY source)"""


def _rounded(sentiment_table):
    columns = ("sentiment_mean", "confidence_mean", "confidence_std")
    return sentiment_table.withColumns({c: F.round(c, 7) for c in columns if c in sentiment_table.columns})


@query(f"WITH {TOPIC_SENTIMENT_SQL} SELECT * FROM table5")
def topic_sentiment(spark, sf):
    return _rounded(sentiment.topic_sentiment(_scored(spark, sf).withColumnRenamed("source", "topic"), digits=None))


@query("""
SELECT user_id AS topic, round(avg(CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 END), 7) AS sentiment_mean,
       count(*) FILTER (WHERE event_type IN ('purchase', 'error')) AS sentence_count,
       round(avg(value), 7) AS confidence_mean, round(stddev_samp(value), 7) AS confidence_std
FROM events GROUP BY user_id""")
def topic_sentiment_with_unknown_labels(spark, sf):
    label = F.when(F.col("event_type") == "purchase", "POSITIVE").when(F.col("event_type") == "error", "NEGATIVE")
    rows = table(spark, sf, "events").select(F.col("user_id").alias("topic"), label.alias("label"), F.col("value").alias("score"))
    return _rounded(sentiment.topic_sentiment(rows, digits=None))


def _user_sentiment(spark, sf):
    rows = table(spark, sf, "events").select(
        F.col("user_id").alias("topic"), F.col("value").alias("score"),
        F.when(F.col("event_type") == "error", "NEGATIVE").otherwise("POSITIVE").alias("label"),
    )
    return sentiment.topic_sentiment(rows, digits=None)


USER_SENTIMENT_SQL = """
FROM (SELECT user_id::INTEGER AS topic, round(avg(CASE WHEN event_type = 'error' THEN -1 ELSE 1 END), 7) AS sentiment_mean,
 count(*) AS sentence_count, round(avg(value), 7) AS confidence_mean, round(stddev_samp(value), 7) AS confidence_std
 FROM events GROUP BY user_id)"""


@query(f"SELECT topic, sentiment_mean {USER_SENTIMENT_SQL}")
def sentiment_by_topic(spark, sf):
    return _rounded(reports.sentiment_by_topic(_user_sentiment(spark, sf)))


@query(f"SELECT topic, confidence_mean, confidence_std {USER_SENTIMENT_SQL}")
def confidence_by_topic(spark, sf):
    return _rounded(reports.confidence_by_topic(_user_sentiment(spark, sf)))


@query(f"SELECT topic, sentence_count {USER_SENTIMENT_SQL}")
def volume_by_topic(spark, sf):
    return reports.volume_by_topic(_user_sentiment(spark, sf))


@query()
def sentiment_trained(spark, sf):
    """Logistic regression trained on the labelled documents, applied to all sentences."""
    docs = texts(spark, sf).select("doc_id", "text")
    labelled = docs.join(table(spark, sf, "labels"), "doc_id")
    model = sentiment.TrainedSentiment.fit(labelled, "text", "quality")
    scored = model.transform(_sentences(spark, sf))
    return scored.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


@query(f"""
WITH s AS ({sql_text.sentences("documents", "text", "doc_id")}),
v AS (SELECT len(regexp_extract_all(lower(sentence), '[aeiou]'))::DOUBLE / greatest(length(sentence), 1) AS share FROM s)
SELECT CASE WHEN share >= 0.4 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS label, count(*) AS n FROM v GROUP BY ALL""")
def sentiment_user_model(spark, sf):
    """A user's model behind the Arrow interface (here: share of vowels)."""

    def load():
        def predict(batch):
            shares = [sum(ch in "aeiou" for ch in t.lower()) / max(len(t), 1) for t in batch]
            return [("POSITIVE" if s >= 0.4 else "NEGATIVE", 0.5 + abs(s - 0.4)) for s in shares]

        return predict

    scored = sentiment.model_sentiment(_sentences(spark, sf), load)
    return scored.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


# --- names -------------------------------------------------------------------------


@query(f"WITH {DETAILS_SQL} SELECT topic_id, words, words[1] || ' + ' || words[2] || ' + ' || words[3] || ' + ' || words[4] AS topic_name FROM details")
def topic_names_default(spark, sf):
    return naming.name_topics(_details(spark, sf))


@query(f"""
WITH {DETAILS_SQL}
SELECT topic_id, CASE WHEN length(topic_id) = 4 THEN 'Topic with No Words'
  ELSE words[1] || ' + ' || words[2] || ' + ' || words[3] || ' + ' || words[4] END AS topic_name FROM details""")
def topic_names_without_words(spark, sf):
    emptied = F.when(F.length("topic_id") == 4, F.array().cast("array<string>")).otherwise(F.col("words"))
    return naming.name_topics(_details(spark, sf).withColumn("words", emptied)).select("topic_id", "topic_name")


@query("""
SELECT event_id, CASE WHEN bare = '' THEN 'Name Gen Failed' ELSE bare END AS topic_name FROM (
  SELECT event_id, replace(replace(trim(CASE WHEN event_type = 'view' THEN ' ** "" ' ELSE '  **"' || event_type || '" ' || user_id || '** ' END),
    '"', ''), '**', '') AS bare FROM events)""")
def name_postprocess(spark, sf):
    raw = F.when(F.col("event_type") == "view", F.lit(' ** "" ')).otherwise(
        F.concat(F.lit('  **"'), "event_type", F.lit('" '), F.col("user_id").cast("string"), F.lit("** "))
    )
    return table(spark, sf, "events").select("event_id", naming.tidy_name(raw).alias("topic_name"))


@query(f"""
WITH {DETAILS_SQL}
SELECT topic_id, replace('{naming.PROMPT.replace("'", "''")}', '%s', array_to_string(words, ', ')) AS prompt FROM details""")
def prompt_text(spark, sf):
    return _details(spark, sf).select("topic_id", naming.prompt(F.array_join("words", ", ")).alias("prompt"))


@query(f"""
WITH {DETAILS_SQL}, info AS (SELECT source AS topic_id, count(*) AS "count" FROM documents GROUP BY source)
SELECT info.topic_id, words[1] || ' + ' || words[2] || ' + ' || words[3] || ' + ' || words[4] AS name, "count"
FROM info LEFT JOIN details USING (topic_id)""")
def topic_name_counts(spark, sf):
    info = assignment.topic_info(table(spark, sf, "documents").withColumnRenamed("source", "topic"))
    return naming.name_counts(info, naming.name_topics(_details(spark, sf)))


# --- report tables --------------------------------------------------------------------

USER_INFO_SQL = """info AS (SELECT CASE WHEN user_id % 7 = 0 THEN -1 ELSE user_id END AS topic, count(*) AS "count" FROM events GROUP BY 1)"""


def _user_info(spark, sf):
    topic = F.when(F.col("user_id") % 7 == 0, F.lit(-1)).otherwise(F.col("user_id"))
    return assignment.topic_info(table(spark, sf, "events").select(topic.alias("topic")))


@query(f"WITH {USER_INFO_SQL} SELECT topic, \"count\" FROM info ORDER BY \"count\" DESC, topic LIMIT 10")
def largest_topics(spark, sf):
    return reports.largest_topics(_user_info(spark, sf))


@query(f"WITH {USER_INFO_SQL}, head AS (SELECT * FROM info ORDER BY \"count\" DESC, topic LIMIT 5) SELECT topic, \"count\" FROM head WHERE topic <> -1")
def leading_topics(spark, sf):
    return reports.leading_topics(_user_info(spark, sf))


@query(f"""
WITH {CLASS_SQL}, info AS (SELECT source AS topic, sum(n_chars) AS "count" FROM documents GROUP BY source),
head AS (SELECT topic FROM info ORDER BY "count" DESC, topic LIMIT 5)
SELECT topic, term, round(weight, 9) AS weight FROM ranked SEMI JOIN head USING (topic)
WHERE rank <= 10 AND length(term) >= 3 AND term NOT IN ({sql_list(settings.TOPIC_STOP_WORDS)})""")
def leading_topic_words(spark, sf):
    info = table(spark, sf, "documents").groupBy(F.col("source").alias("topic")).agg(F.sum("n_chars").alias("count"))
    words = reports.leading_topic_words(info, source_weights(spark, sf))
    return words.withColumn("weight", F.round("weight", 9))


@query(f"""
WITH s AS ({sql_text.sentences("documents", "text", "doc_id, lang")}),
l AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS topic FROM (SELECT DISTINCT lang FROM documents))
SELECT row_number() OVER (ORDER BY doc_id, sent_pos) - 1 AS document_id, topic::INTEGER AS topic, sentence
FROM s JOIN l USING (lang)""")
def document_topics(spark, sf):
    topic = F.array_position(F.array(*[F.lit(x) for x in ("de", "en", "es", "fr")]), F.col("lang")) - 1
    rows = _sentences(spark, sf, "lang").withColumn("topic", topic.cast("int"))
    return reports.document_topics(rows, ["doc_id", "sent_pos"])


@query(f"""
WITH s AS ({sql_text.sentences("documents", "text", "doc_id")}),
b AS (SELECT doc_id, sent_pos, length(sentence) AS n FROM s),
a AS (SELECT doc_id, sent_pos, sentence FROM s)
SELECT doc_id, sent_pos, sentence, n::INTEGER AS n FROM a JOIN b USING (doc_id, sent_pos)""")
def positional_zip(spark, sf):
    sentences = _sentences(spark, sf)
    sizes = sentences.select("doc_id", "sent_pos", F.length("sentence").alias("n"))
    return sentences.join(sizes, ["doc_id", "sent_pos"])


# --- topic models (checked by row counts here, by invariants in the tests) -------------

TOPICS = 8


def _study(spark, sf, method):
    documents = text.study_sentences(texts(spark, sf), "text", ["doc_id"])
    return topic_study.study_input(documents.select("doc_id", "sent_pos", "tokens"), ["doc_id", "sent_pos"], method)


def _fitted(spark, sf, method, **options):
    data = _study(spark, sf, method)
    return data, topic_study.FITTERS[method](data.features, TOPICS, data.space.terms, **options)


@query()
def lsa_topics(spark, sf):
    _, model = _fitted(spark, sf, "lsa")
    return topic_export(model, spark)


@query()
def lsa_explained_variance(spark, sf):
    data, model = _fitted(spark, sf, "lsa")
    model.explain(data.features)
    return model.topic_importance(spark)


@query()
def nmf_topics(spark, sf):
    _, model = _fitted(spark, sf, "nmf")
    return topic_export(model, spark)


@query()
def lda_topics(spark, sf):
    _, model = _fitted(spark, sf, "lda")
    return topic_export(model, spark)


@query()
def document_distribution(spark, sf):
    data, model = _fitted(spark, sf, "lsa")
    return first_max_topics(model, data.features, data.keys).select("doc_id", "sent_pos", "topic", F.round("strength", 6).alias("strength"))


@query()
def document_map(spark, sf):
    data, model = _fitted(spark, sf, "lsa")
    return reports.document_map(model.transform(data.features, data.keys), data.keys)


@query()
def topic_count_study(spark, sf):
    data = _study(spark, sf, "lsa")
    return topic_study.find_topic_count(data, counts=(5, 8), gate=False).metrics


@query()
def lsa_report(spark, sf):
    data, model = _fitted(spark, sf, "lsa")
    model.explain(data.features)
    return topic_study.report(model, spark)


@query()
def fixed_lsa_topics(spark, sf):
    data = fixed_study.fixed_input(fixed_docs(spark, sf), ["doc_id"])
    return fixed_study.export(data, fixed_study.fit_fixed(data, "lsa", TOPICS))


@query()
def fixed_lda_topics(spark, sf):
    data = fixed_study.fixed_input(fixed_docs(spark, sf), ["doc_id"])
    return fixed_study.export(data, fixed_study.fit_fixed(data, "lda", TOPICS))


@query()
def fixed_lsa_coherence(spark, sf):
    data = fixed_study.fixed_input(fixed_docs(spark, sf), ["doc_id"])
    return fixed_study.coherence(data, fixed_study.fit_fixed(data, "lsa", TOPICS))


# --- embedding topics ---------------------------------------------------------------------

EPSILON, SAMPLES, CLUSTER = 1.2, 6, 8


@query(f"""
WITH RECURSIVE cells AS (
  SELECT list_transform(embedding::DOUBLE[], lambda x: CAST(floor(x / {EPSILON / 16!r}) AS BIGINT)) AS cell, vec_id, embedding::DOUBLE[] AS v FROM embeddings),
near AS (SELECT a.vec_id AS a, b.vec_id AS b, list_distance(a.v, b.v) AS d FROM cells a, cells b WHERE list_distance(a.v, b.v) <= {EPSILON}),
core AS (SELECT a AS id, d AS core FROM (SELECT a, d, row_number() OVER (PARTITION BY a ORDER BY d) AS place FROM near) WHERE place = {SAMPLES}),
edges AS (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
walk(id, root) AS (SELECT id, id FROM core UNION SELECT e.b, w.root FROM walk w JOIN edges e ON e.a = w.id),
label AS (SELECT id, min(root) AS label FROM walk GROUP BY id),
big AS (SELECT l.label, count(*) AS n, min(CAST(c.cell AS VARCHAR)) AS first, min(o.core) AS best
        FROM label l JOIN cells c ON c.vec_id = l.id JOIN core o ON o.id = l.id GROUP BY l.label HAVING count(*) >= {CLUSTER}),
topics AS (SELECT label, best, row_number() OVER (ORDER BY n DESC, first) - 1 AS topic FROM big)
SELECT c.vec_id, coalesce(t.topic, -1)::INTEGER AS topic,
  round(CASE WHEN t.topic IS NULL THEN 0.0 WHEN o.core > 0 THEN least(1.0, t.best / o.core) ELSE 1.0 END, 6)::DOUBLE AS strength
FROM cells c LEFT JOIN label l ON l.id = c.vec_id LEFT JOIN core o ON o.id = c.vec_id LEFT JOIN topics t ON t.label = l.label""")
def density_clusters(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    found = density.density_topics(vectors, ["vec_id"], "v", 64, EPSILON, SAMPLES, CLUSTER)
    return found.select("vec_id", "topic", F.round("strength", 6).alias("strength"))


@query()
def reduced_embeddings(spark, sf):
    reduced = embedding.reduce_dimensions(table(spark, sf, "embeddings"), ["vec_id"])
    return reduced.select("vec_id", "reduced")


@query()
def kmeans_clusters(spark, sf):
    reduced = embedding.reduce_dimensions(table(spark, sf, "embeddings"), ["vec_id"])
    return embedding.kmeans_topics(reduced, ["vec_id"], 10)


@query()
def topic_map(spark, sf):
    rows = table(spark, sf, "embeddings").withColumnRenamed("label", "topic")
    return reports.topic_map(assignment.topic_vectors(rows), assignment.topic_info(rows))


@query()
def sentence_embeddings(spark, sf):
    tokens = review_analysis.topic_tokens(_sentences(spark, sf), ["doc_id", "sent_pos"])
    return embedding.embed_by_lsa(tokens, ["doc_id", "sent_pos"]).select("doc_id", "sent_pos", "embedding")


@query(f"""
WITH s AS ({sql_text.sentences("documents", "text", "doc_id")})
SELECT doc_id, sent_pos, array_to_string(list_transform(['a', 'e', 'i', 'n', 'o', 'r', 's', 't'],
  lambda c: length(lower(sentence)) - length(replace(lower(sentence), c, ''))), ',') AS embedding FROM s""")
def user_embeddings(spark, sf):
    """A user's encoder behind the Arrow interface (here: letter counts)."""

    def load():
        return lambda batch: [[t.lower().count(ch) for ch in "aeinorst"] for t in batch]

    vectors = embedding.embed_with(_sentences(spark, sf), load)
    counts = F.transform("embedding", lambda x: x.cast("int").cast("string"))
    return vectors.select("doc_id", "sent_pos", F.array_join(counts, ",").alias("embedding"))


@query()
def review_analysis_sentiment(spark, sf):
    """The whole analysis over all documents: sentiment per discovered topic."""
    tables = review_analysis.run_analysis(
        texts(spark, sf), "text", "doc_id",
        clustering={"epsilon": 0.12, "min_samples": 20, "min_cluster_size": 50}, embed={"dimensions": 16},
    )
    return tables["sentiment_analysis"]
