"""Vocabularies, bags of words, TF-IDF, topic words, similarity and quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlens import settings
from reviewlens.catalog import sql_text
from reviewlens.catalog.registry import query, table, texts
from reviewlens.functions import text, vectors
from reviewlens.scale import join_lookup
from reviewlens.operators import assignment, class_tfidf, quality, topic_words, vocabulary

STUDY_SQL = f"""
docs AS (
  SELECT * FROM (SELECT doc_id, source, {sql_text.tokens(sql_text.unicode_norm('text'), settings.STUDY_STOP_WORDS)} AS tokens FROM documents)
  WHERE len(tokens) > 0),
bow AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM docs) GROUP BY ALL),
terms AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM bow GROUP BY term),
vocab AS (
  SELECT term, df, tf, row_number() OVER (ORDER BY term) - 1 AS term_id FROM (
    SELECT * FROM terms
    WHERE df >= {settings.STUDY_MIN_DF} AND df <= {settings.STUDY_MAX_DF} * (SELECT count(*) FROM docs)
      AND term NOT IN ({sql_text.sql_list(settings.STUDY_STOP_WORDS)})
    ORDER BY tf DESC, term LIMIT {settings.STUDY_MAX_FEATURES}))"""

FIXED_SQL = f"""
{sql_text.fixed_docs()},
bow AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM fixed) GROUP BY ALL),
terms AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM bow GROUP BY term),
dict AS (
  SELECT term, df, tf, row_number() OVER (ORDER BY df DESC, term) - 1 AS term_id FROM (
    SELECT * FROM terms
    WHERE df >= {settings.FIXED_NO_BELOW} AND df <= {settings.FIXED_NO_ABOVE} * (SELECT count(*) FROM fixed)
    ORDER BY df DESC, term LIMIT {settings.FIXED_KEEP_N}))"""

SMOOTH_SQL = f"""{STUDY_SQL},
raw AS (SELECT doc_id, term, term_id,
  bow.tf * (ln((1 + (SELECT count(*) FROM docs)) / (1 + df)) + 1) AS raw FROM bow JOIN vocab USING (term)),
tfidf AS (SELECT doc_id, term, term_id, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS w FROM raw)"""

# Topics with the source in the role of the topic.
CLASS_SQL = f"""{STUDY_SQL},
counts AS (SELECT source AS topic, term, sum(tf) AS tf FROM bow JOIN docs USING (doc_id) GROUP BY ALL),
sizes AS (SELECT topic, sum(tf) AS topic_words FROM counts GROUP BY topic),
freq AS (SELECT term, sum(tf) AS f FROM counts GROUP BY term),
weights AS (SELECT topic, term,
  tf / topic_words * ln(1 + (SELECT floor(avg(topic_words)) FROM sizes) / f) AS weight
  FROM counts JOIN sizes USING (topic) JOIN freq USING (term)),
ranked AS (SELECT topic, term, weight, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term) AS rank FROM weights)"""


def _study_docs(spark, sf):
    """One token list per document, with study normalisation."""
    tokens = text.tokens(text.normalize_unicode(F.col("text")), settings.STUDY_STOP_WORDS)
    docs = text.evaluated_once(texts(spark, sf), ["doc_id", "source"], tokens, "tokens")
    return docs.filter(F.size("tokens") > 0)


def study_docs(spark, sf):
    """The token lists, kept for several readers."""
    return _study_docs(spark, sf).persist()


def fixed_docs(spark, sf):
    return text.fixed_tokens(texts(spark, sf), "text", ["doc_id"]).persist()


def source_weights(spark, sf):
    return class_tfidf.class_tfidf(class_tfidf.class_term_counts(_study_docs(spark, sf), "source"))


@query(f"WITH {STUDY_SQL} SELECT term, df, tf FROM terms")
def vocabulary_counts(spark, sf):
    return vocabulary.term_counts(study_docs(spark, sf))


@query(f"WITH {STUDY_SQL} SELECT term, df, tf, term_id::INTEGER AS term_id FROM vocab")
def study_vocabulary(spark, sf):
    return vocabulary.study_vocabulary(study_docs(spark, sf))


@query(f"WITH {FIXED_SQL} SELECT term, df, tf, term_id::INTEGER AS term_id FROM dict")
def trimmed_dictionary(spark, sf):
    return vocabulary.trimmed_dictionary(fixed_docs(spark, sf))


@query(f"WITH {STUDY_SQL} SELECT doc_id, term, tf FROM bow")
def bag_of_words(spark, sf):
    return vocabulary.bag_of_words(_study_docs(spark, sf), ["doc_id"])


@query(f"WITH {FIXED_SQL} SELECT doc_id, term_id::INTEGER AS term_id, bow.tf AS n FROM bow JOIN dict USING (term)")
def bag_of_known_words(spark, sf):
    docs = fixed_docs(spark, sf)
    bow = vocabulary.bag_of_words(docs, ["doc_id"])
    known = vocabulary.in_vocabulary(bow, vocabulary.trimmed_dictionary(docs))
    return known.select("doc_id", "term_id", F.col("tf").alias("n"))


@query(f"WITH {SMOOTH_SQL} SELECT doc_id, term, round(w, 8) AS w FROM tfidf")
def tfidf_smooth(spark, sf):
    docs = study_docs(spark, sf)
    weights = vocabulary.tfidf_long(docs, vocabulary.study_vocabulary(docs), ["doc_id"])
    return weights.select("doc_id", "term", F.round("w", 8).alias("w"))


@query(f"""
WITH {FIXED_SQL},
raw AS (SELECT doc_id, term, bow.tf * log2((SELECT count(*) FROM fixed) / df) AS raw FROM bow JOIN dict USING (term))
SELECT doc_id, term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)), 8) AS w FROM raw""")
def tfidf_log2(spark, sf):
    docs = fixed_docs(spark, sf)
    weights = vocabulary.tfidf_long(docs, vocabulary.trimmed_dictionary(docs), ["doc_id"], variant="log2")
    return weights.select("doc_id", "term", F.round("w", 8).alias("w"))


@query(f"WITH {SMOOTH_SQL} SELECT doc_id, count(*) AS terms, round(sum(w), 6) AS total FROM tfidf GROUP BY doc_id")
def tfidf_vectors(spark, sf):
    """The shuffle-free vector form must carry the same weights as the long form."""
    docs = study_docs(spark, sf)
    features = vocabulary.feature_space(docs, "study", "smooth").transform(docs)
    sums = vocabulary.vector_sums(features, ["doc_id"])
    return sums.select("doc_id", "terms", F.round("total", 6).alias("total")).filter("terms > 0")


@query(f"WITH {CLASS_SQL} SELECT topic, term, round(weight, 9) AS weight, rank::INTEGER AS rank FROM ranked WHERE rank <= 10")
def class_tfidf_words(spark, sf):
    top = topic_words.top_words(source_weights(spark, sf))
    return top.withColumn("weight", F.round("weight", 9))


@query(f"""
WITH {CLASS_SQL}, grams AS (
  SELECT source AS topic, unnest(tokens || list_transform(range(1, len(tokens)), lambda i: tokens[i] || ' ' || tokens[i + 1])) AS term FROM docs),
gc AS (SELECT topic, term, count(*) AS tf FROM grams GROUP BY ALL),
spread AS (SELECT term FROM gc GROUP BY term HAVING count(*) >= {settings.TOPIC_MIN_DF}
           AND count(*) <= {settings.TOPIC_MAX_DF} * (SELECT count(DISTINCT topic) FROM gc))
SELECT topic, term, tf FROM gc SEMI JOIN spread USING (term)""")
def topic_ngram_counts(spark, sf):
    counts = class_tfidf.class_term_counts(_study_docs(spark, sf), "source", sizes=settings.TOPIC_NGRAMS)
    return class_tfidf.limit_by_topics(counts).select("topic", "term", "tf")


@query(f"""
WITH {CLASS_SQL},
signed AS (SELECT topic, term, CASE WHEN length(term) % 2 = 0 THEN -weight ELSE weight END AS weight FROM weights),
o AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY abs(weight) DESC, term) AS rank FROM signed)
SELECT topic, term, round(weight, 9) AS weight, rank::INTEGER AS rank FROM o WHERE rank <= 10""")
def top_words_absolute(spark, sf):
    signed = source_weights(spark, sf).withColumn(
        "weight", F.when(F.length("term") % 2 == 0, -F.col("weight")).otherwise(F.col("weight"))
    )
    return topic_words.top_words(signed, absolute=True).withColumn("weight", F.round("weight", 9))


@query(f"""
WITH {CLASS_SQL}, imp AS (SELECT topic, sum(weight) AS importance FROM weights GROUP BY topic),
pos AS (SELECT *, row_number() OVER (ORDER BY importance DESC, topic) AS position FROM imp)
SELECT position::INTEGER AS position, topic, round(importance, 9) AS importance, rank::INTEGER AS rank, term,
       round(weight, 9) AS weight
FROM ranked JOIN pos USING (topic) WHERE rank <= {settings.REPORT_WORDS}""")
def topic_report(spark, sf):
    weights = source_weights(spark, sf)
    report = topic_words.report_rows(weights, topic_words.importance(weights))
    return report.withColumns({"importance": F.round("importance", 9), "weight": F.round("weight", 9)})


@query(f"WITH {CLASS_SQL} SELECT topic, term, round(weight / sum(weight) OVER (PARTITION BY topic), 9) AS weight FROM weights")
def l1_normalised(spark, sf):
    return topic_words.l1_normalised(source_weights(spark, sf)).select("topic", "term", F.round("weight", 9).alias("weight"))


@query(f"WITH {CLASS_SQL} SELECT topic, term, round(weight / max(weight) OVER (PARTITION BY topic), 9) AS scaled FROM weights")
def scaled_to_top(spark, sf):
    return topic_words.scaled_to_top(source_weights(spark, sf)).select("topic", "term", F.round("scaled", 9).alias("scaled"))


DETAILS_SQL = f"""{CLASS_SQL}, details AS (
SELECT topic AS topic_id, list(term ORDER BY rank) AS words, list(round(weight, 9) ORDER BY rank) AS scores
FROM ranked WHERE rank <= 10 GROUP BY topic)"""


def _details(spark, sf):
    return topic_words.topic_details(topic_words.top_words(source_weights(spark, sf)))


@query(f"WITH {DETAILS_SQL} SELECT topic_id, words, scores FROM details")
def topic_details(spark, sf):
    details = _details(spark, sf)
    return details.withColumn("scores", F.transform("scores", lambda s: F.round(s, 9)))


@query(f"WITH {DETAILS_SQL} SELECT topic_id, words[1] || ' + ' || words[2] || ' + ' || words[3] || ' + ' || words[4] AS label FROM details")
def topic_labels(spark, sf):
    return topic_words.topic_labels(_details(spark, sf)).select("topic_id", "label")


@query(f"WITH {CLASS_SQL} SELECT topic, round(sum(weight), 9) AS importance FROM weights GROUP BY topic")
def topic_importance(spark, sf):
    return topic_words.importance(source_weights(spark, sf)).withColumn("importance", F.round("importance", 9))


# --- assignment -------------------------------------------------------------


@query("SELECT label AS topic, count(*) AS \"count\" FROM embeddings GROUP BY label")
def topic_info(spark, sf):
    return assignment.topic_info(table(spark, sf, "embeddings").withColumnRenamed("label", "topic"))


@query("""
SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INTEGER AS topic FROM embeddings""")
def dominant_topic(spark, sf):
    return assignment.dominant_topic(table(spark, sf, "embeddings"), "embedding").select("vec_id", "topic")


DOMINANT_SQL = "dominant AS (SELECT (list_position(embedding, list_max(embedding)) - 1)::INTEGER AS topic FROM embeddings)"


@query(f"""
WITH {DOMINANT_SQL}
SELECT k.topic::INTEGER AS topic, count(d.topic) AS n FROM (SELECT unnest(range(70)) AS topic) k
LEFT JOIN dominant d USING (topic) GROUP BY k.topic""")
def topic_sizes_zero_filled(spark, sf):
    return assignment.topic_sizes(assignment.dominant_topic(table(spark, sf, "embeddings"), "embedding"), 70)


@query(f"""
WITH {DOMINANT_SQL}, sizes AS (
  SELECT k.topic, count(d.topic) AS n FROM (SELECT unnest(range(70)) AS topic) k LEFT JOIN dominant d USING (topic) GROUP BY k.topic),
v AS (SELECT count(*) FILTER (WHERE n BETWEEN floor({settings.VALID_MIN_SHARE} * (SELECT sum(n) FROM sizes))
                              AND floor({settings.VALID_MAX_SHARE} * (SELECT sum(n) FROM sizes))) AS valid_topics,
             count(*) AS n_topics FROM sizes)
SELECT valid_topics, n_topics, valid_topics >= {settings.VALID_GATE} * n_topics AS passes FROM v""")
def valid_topics(spark, sf):
    assigned = assignment.dominant_topic(table(spark, sf, "embeddings"), "embedding")
    return assignment.valid_topics(assignment.topic_sizes(assigned, 70))


@query("""
WITH e AS (SELECT vec_id, label - 1 AS cluster FROM embeddings),
s AS (SELECT cluster, row_number() OVER (ORDER BY count(*) DESC, cluster) - 1 AS topic FROM e WHERE cluster <> -1 GROUP BY cluster)
SELECT vec_id, coalesce(topic, -1)::INTEGER AS topic FROM e LEFT JOIN s USING (cluster)""")
def topics_ordered_by_size(spark, sf):
    clusters = table(spark, sf, "embeddings").select("vec_id", (F.col("label") - 1).alias("cluster"))
    return assignment.order_by_size(clusters, keys=["vec_id"]).select("vec_id", "topic")


MEANS_SQL = """
long AS (SELECT label AS topic, unnest(embedding)::DOUBLE AS w, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings),
means AS (SELECT topic, dim, avg(w) AS w FROM long GROUP BY ALL)"""


@query(f"WITH {MEANS_SQL} SELECT topic, dim::INTEGER AS dim, round(w, 8) AS w FROM means")
def topic_vectors(spark, sf):
    topics = assignment.topic_vectors(table(spark, sf, "embeddings").withColumnRenamed("label", "topic"))
    return assignment.vector_dims(topics).withColumn("w", F.round("w", 8))


@query(f"""
WITH {MEANS_SQL}, v AS (SELECT topic, list(w ORDER BY dim) AS v FROM means GROUP BY topic)
SELECT a.topic AS topic_a, b.topic AS topic_b, round(list_cosine_similarity(a.v, b.v), 8) AS similarity
FROM v a, v b""")
def topic_similarity(spark, sf):
    topics = assignment.topic_vectors(table(spark, sf, "embeddings").withColumnRenamed("label", "topic"))
    return assignment.topic_similarity(topics, digits=None).withColumn("similarity", F.round("similarity", 8))


@query("""
WITH m AS (SELECT label, list(w ORDER BY dim) AS v FROM (
  SELECT label, dim, avg(w) AS w FROM (SELECT label, unnest(embedding)::DOUBLE AS w, generate_subscripts(embedding, 1) AS dim FROM embeddings)
  GROUP BY ALL) GROUP BY label)
SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], v), 8) AS similarity FROM embeddings JOIN m USING (label)""")
def cosine_to_topic(spark, sf):
    rows = table(spark, sf, "embeddings").withColumnRenamed("label", "topic")
    means = assignment.topic_vectors(rows)
    joined = join_lookup(rows, means, "topic", ["vec_id"], "inner")
    return joined.select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("vector")), 8).alias("similarity"))


# --- quality -------------------------------------------------------------------


def _top_ten(spark, sf):
    return topic_words.top_words(source_weights(spark, sf)).select("topic", "term")


COHERENCE_SQL = f"""
{CLASS_SQL},
raw AS (SELECT doc_id, term, bow.tf * (ln((1 + (SELECT count(*) FROM docs)) / (1 + df)) + 1) AS raw FROM bow JOIN vocab USING (term)),
tfidf AS (SELECT doc_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS w FROM raw),
top AS (SELECT topic, term FROM ranked WHERE rank <= 10),
norms AS (SELECT term, sqrt(sum(w * w)) AS norm FROM tfidf GROUP BY term),
pairs AS (
  SELECT a.topic, a.term AS t1, b.term AS t2, sum(x.w * y.w) / (n1.norm * n2.norm) AS c
  FROM top a JOIN top b ON a.topic = b.topic AND a.term < b.term
  JOIN tfidf x ON x.term = a.term JOIN tfidf y ON y.term = b.term AND y.doc_id = x.doc_id
  JOIN norms n1 ON n1.term = a.term JOIN norms n2 ON n2.term = b.term
  GROUP BY a.topic, a.term, b.term, n1.norm, n2.norm),
coherent AS (
SELECT t.topic, 2 * coalesce(p.s, 0) / (t.n * (t.n - 1)) AS coherence
FROM (SELECT topic, count(*) AS n FROM top GROUP BY topic) t
LEFT JOIN (SELECT topic, sum(c) AS s FROM pairs GROUP BY topic) p USING (topic))"""


def _coherence(spark, sf):
    docs = study_docs(spark, sf)
    space = vocabulary.feature_space(docs, variant="smooth")
    return quality.cosine_coherence(space.transform(docs), space.terms, _top_ten(spark, sf))


@query(f"WITH {COHERENCE_SQL} SELECT topic, round(coherence, 8) AS coherence FROM coherent")
def coherence_cosine(spark, sf):
    return _coherence(spark, sf).withColumn("coherence", F.round("coherence", 8))


@query(f"WITH {COHERENCE_SQL} SELECT round(avg(coherence), 8) AS coherence FROM coherent")
def coherence_mean(spark, sf):
    return quality.mean_coherence(_coherence(spark, sf)).withColumn("coherence", F.round("coherence", 8))


@query(f"""
WITH {CLASS_SQL}
SELECT round(count(DISTINCT term) / (count(DISTINCT topic) * 10), 9) AS diversity FROM ranked WHERE rank <= 10""")
def diversity(spark, sf):
    return quality.diversity(_top_ten(spark, sf)).withColumn("diversity", F.round("diversity", 9))


def _stability_half(half: str) -> str:
    return f"""
c{half} AS (SELECT source AS topic, term, sum(tf) AS w FROM bow JOIN docs USING (doc_id) WHERE md5(concat_ws('|', CAST(doc_id AS VARCHAR), '{half}'))
  < 'cccccccccccccccc' GROUP BY ALL),
n{half} AS (SELECT topic, term, w / sqrt(sum(w * w) OVER (PARTITION BY topic)) AS w FROM c{half})"""


@query(f"""
WITH {STUDY_SQL}, {_stability_half('1')}, {_stability_half('2')},
sim AS (SELECT a.topic AS ta, b.topic AS tb, sum(a.w * b.w) AS s FROM n1 a JOIN n2 b USING (term) GROUP BY ALL)
SELECT round(avg(best), 8) AS stability FROM (SELECT ta, max(s) AS best FROM sim GROUP BY ta)""")
def row_max_mean(spark, sf):
    """Stability arithmetic on two 80% samples: mean of per-topic best cosines."""
    from reviewlens.operators.sampling import share_sample

    docs = study_docs(spark, sf)

    def counts(seed):
        sample = share_sample(docs, settings.STABILITY_SHARE, ["doc_id"], seed)
        return class_tfidf.class_term_counts(sample, "source").withColumnRenamed("tf", "weight")

    similarity = quality.model_similarity(counts(1), counts(2))
    return quality.row_max_mean(similarity).withColumn("stability", F.round("stability", 8))


SCORE_SQL = """
m AS (SELECT user_id AS n_topics, avg(value) / 1000 AS coherence, count(DISTINCT event_type) / 5 AS diversity,
        count(*) FILTER (WHERE event_type = 'view') / count(*) AS stability, sum(value) - 500 AS performance
      FROM events GROUP BY user_id),
s AS (SELECT *, 0.3 * (coherence / (1 + coherence)) + 0.2 * diversity + 0.2 * stability
   + 0.3 * ((performance - least(performance, 0)) / (1 + abs(performance))) AS combined_score FROM m)"""


def _metric_rows(spark, sf):
    """One metrics row per user of the event table."""
    rows = table(spark, sf, "events").groupBy(F.col("user_id").alias("n_topics")).agg(
        (F.avg("value") / 1000).alias("coherence"),
        (F.countDistinct("event_type") / 5).alias("diversity"),
        (F.count_if(F.col("event_type") == "view") / F.count(F.lit(1))).alias("stability"),
        (F.sum("value") - 500).alias("performance"),
    )
    return rows.withColumn(
        "combined_score",
        quality.combined_score(F.col("coherence"), F.col("diversity"), F.col("stability"), F.col("performance")),
    )


@query(f"WITH {SCORE_SQL} SELECT n_topics, round(combined_score, 8) AS combined_score FROM s")
def combined_score(spark, sf):
    return _metric_rows(spark, sf).select("n_topics", F.round("combined_score", 8).alias("combined_score"))


@query(f"WITH {SCORE_SQL} SELECT n_topics, round(combined_score, 8) AS combined_score FROM s ORDER BY combined_score DESC, n_topics LIMIT 1")
def best_configuration(spark, sf):
    best = quality.best_row(_metric_rows(spark, sf))
    return best.select("n_topics", F.round("combined_score", 8).alias("combined_score"))


WINDOW = settings.COHERENCE_WINDOW


@query(f"""
WITH {CLASS_SQL}, top AS (SELECT topic, term FROM ranked WHERE rank <= {settings.COHERENCE_WORDS}),
pos AS (SELECT doc_id, len(tokens) AS len, unnest(tokens) AS term, generate_subscripts(tokens, 1) - 1 AS pos FROM docs),
hits AS (SELECT doc_id, term, pos, greatest(len - {WINDOW}, 0) AS last FROM pos SEMI JOIN top USING (term)),
total AS (SELECT sum(n) AS n FROM (SELECT doc_id, max(last) + 1 AS n FROM hits GROUP BY doc_id)),
seen AS (SELECT DISTINCT doc_id, term, unnest(range(greatest(pos - {WINDOW} + 1, 0), least(pos, last) + 1)) AS start FROM hits),
single AS (SELECT term, count(*) / (SELECT n FROM total) AS p FROM seen GROUP BY term),
wanted AS (SELECT DISTINCT a.term AS i, b.term AS j FROM top a JOIN top b USING (topic) WHERE a.term <= b.term),
half AS (SELECT i, j, count(*) / (SELECT n FROM total) AS p FROM wanted
         JOIN seen x ON x.term = i JOIN seen y ON y.term = j AND y.doc_id = x.doc_id AND y.start = x.start GROUP BY i, j),
joint AS (SELECT i, j, p FROM half UNION SELECT j, i, p FROM half),
npmi AS (SELECT a.topic, a.term AS i, b.term AS j,
   ln((coalesce(p, 0) + {settings.COHERENCE_EPSILON}) / (s1.p * s2.p)) / -ln(coalesce(joint.p, 0) + {settings.COHERENCE_EPSILON}) AS m
  FROM top a JOIN top b ON a.topic = b.topic LEFT JOIN joint ON joint.i = a.term AND joint.j = b.term
  JOIN single s1 ON s1.term = a.term JOIN single s2 ON s2.term = b.term),
tv AS (SELECT topic, j, sum(m) AS s FROM npmi GROUP BY ALL),
c AS (SELECT topic, i, sum(m * s) / sqrt(sum(m * m) * sum(s * s)) AS c FROM npmi JOIN tv USING (topic, j) GROUP BY ALL)
SELECT topic, round(avg(c), 6) AS c_v FROM c GROUP BY topic""".replace("coalesce(p, 0) +", "coalesce(joint.p, 0) +"))
def coherence_cv(spark, sf):
    top = topic_words.top_words(source_weights(spark, sf), settings.COHERENCE_WORDS)
    found = quality.window_coherence(study_docs(spark, sf), top)
    return found.withColumn("c_v", F.round("c_v", 6))
