"""LSA / LDA / NMF over normalised sentences, with choice of the topic count."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Iterable

from pyspark.sql import DataFrame, functions as F

from reviewlens import settings
from reviewlens.functions.text import study_sentences
from reviewlens.operators import assignment, quality, reports, topic_words
from reviewlens.operators.lda import fit_lda
from reviewlens.operators.lemmas import with_attested_lemmas
from reviewlens.operators.nmf import fit_nmf
from reviewlens.operators.resamples import fit_lsa_resampled
from reviewlens.operators.svd import fit_lsa
from reviewlens.operators.topic_model import TopicModel, first_max_topics, stability
from reviewlens.operators.vocabulary import FeatureSpace, study_vocabulary
from reviewlens.sources import results

FITTERS = {"lsa": fit_lsa, "lda": fit_lda, "nmf": fit_nmf}
METRICS = (
    "method string, n_topics int, coherence double, diversity double, stability double, "
    "performance double, valid_topics int, reason string"
)


@dataclass
class StudyInput:
    """Vectorised documents, persisted for all topic counts of one method."""

    method: str
    keys: list[str]
    features: DataFrame
    space: FeatureSpace

    def release(self) -> None:
        self.features.unpersist()


@dataclass
class StudyResult:
    metrics: DataFrame
    best: dict | None
    model: TopicModel | None
    rows: list[dict] = field(default_factory=list)


def study_input(tokens_df: DataFrame, keys: list[str], method: str, **limits) -> StudyInput:
    """Counts for LDA, TF-IDF for LSA and NMF."""
    tokens_df = tokens_df.persist()
    variant = "count" if method == "lda" else "smooth"
    vocabulary = study_vocabulary(tokens_df, **limits).persist()
    space = FeatureSpace(vocabulary, tokens_df.count(), variant)
    features = space.transform(tokens_df).select(*keys, "features").persist()
    features.count()  # kept from here on: the tokens need not stay beside them
    tokens_df.unpersist()
    return StudyInput(method, keys, features, space)


def judge(
    data: StudyInput, model: TopicModel, stability_runs: int = settings.STABILITY_RUNS, gate: bool = True, again: list[TopicModel] | None = None
) -> dict:
    """Size gate and metrics of one fitted model; ``again`` holds its refits on samples, if they exist."""
    spark = data.features.sparkSession
    dominant = first_max_topics(model, data.features, data.keys)
    sizes = assignment.valid_topics(assignment.topic_sizes(dominant, model.k)).head()
    row = {
        "method": data.method, "n_topics": model.k, "coherence": None, "diversity": None, "stability": None,
        "performance": None, "valid_topics": int(sizes["valid_topics"]), "reason": None,
    }
    if gate and not sizes["passes"]:
        row["reason"] = f"only {sizes['valid_topics']} of {model.k} topics have an allowed size"
        return row
    top = topic_words.top_words(model.topic_terms(spark, settings.TOP_WORDS)).select("topic", "term").persist()
    row["coherence"] = float(quality.mean_coherence(quality.cosine_coherence(data.features, data.space.terms, top)).head()[0])
    row["diversity"] = float(quality.diversity(top).head()[0])
    row["performance"] = float(model.performance(data.features))
    row["stability"] = stability(model, data.features, data.keys, runs=stability_runs, again=again) if stability_runs else 0.0
    top.unpersist()
    return row


def metrics_frame(spark, rows: list[dict]) -> DataFrame:
    """One row per topic count with the combined score."""
    names = [part.split()[0] for part in METRICS.split(", ")]
    frame = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], METRICS)
    score = quality.combined_score(F.col("coherence"), F.col("diversity"), F.col("stability"), F.col("performance"))
    return frame.withColumn("combined_score", score)


def find_topic_count(
    data: StudyInput,
    counts: Iterable[int] = settings.SWEEP_TOPICS,
    stability_runs: int = settings.STABILITY_RUNS,
    gate: bool = True,
    **fit_options,
) -> StudyResult:
    """Fit every topic count, measure it, keep the best.

    LSA is fitted once, with the largest count, together with its refits on samples of the
    rows.  When no count passes the size gate, ``best`` is None and the metrics say why.
    """
    spark = data.features.sparkSession
    rows, models = [], {}
    counts, terms = list(counts), data.space.terms
    widest, resampled = None, []
    if data.method == "lsa" and counts:
        # the components of an SVD are nested: one fit serves all counts
        widest, resampled = fit_lsa_resampled(data.features, max(counts), terms, data.keys, runs=stability_runs, **fit_options)
    for k in counts:
        model = widest.leading(k) if widest else FITTERS[data.method](data.features, k, terms, **fit_options)
        models[model.k] = model
        rows.append(judge(data, model, stability_runs, gate, [other.leading(k) for other in resampled] if widest else None))
    metrics = metrics_frame(spark, rows)
    winner = quality.best_row(metrics.filter(F.col("reason").isNull())).head()
    if winner is None:
        return StudyResult(metrics, None, None, rows)
    return StudyResult(metrics, winner.asDict(), models[winner["n_topics"]], rows)


def report(model: TopicModel, spark) -> DataFrame:
    terms = model.topic_terms(spark, settings.REPORT_WORDS)
    return topic_words.report_rows(terms, model.topic_importance(spark))


def run_study(
    reviews: DataFrame,
    text: str,
    keys: list[str],
    base: str,
    methods: Iterable[str] = ("lsa", "lda", "nmf"),
    counts: Iterable[int] = settings.SWEEP_TOPICS,
    attested: bool = False,
    **options,
) -> dict[str, StudyResult]:
    """Study of all methods; writes a report and a document map per method.

    ``attested`` takes lemmas that the reviews attest instead of those by endings alone.
    """
    doc_keys = [*keys, "sent_pos"]
    documents = study_sentences(reviews, text, keys, lemmatize=not attested)
    if attested:
        documents = with_attested_lemmas(documents, doc_keys)
    documents = documents.persist()
    found = {}
    for method in methods:
        data = study_input(documents.select(*doc_keys, "tokens"), doc_keys, method)
        result = find_topic_count(data, counts, **options)
        result.metrics.coalesce(1).write.mode("overwrite").parquet(f"{base}/{method}_metrics")
        if result.model is not None:
            results.write_report(result.best, report(result.model, reviews.sparkSession), f"{base}/{method}_report")
            spread = result.model.transform(data.features, doc_keys)
            reports.document_map(spread, doc_keys).write.mode("overwrite").parquet(f"{base}/{method}_document_map")
        data.release()
        found[method] = result
    return found
