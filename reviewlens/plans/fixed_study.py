"""LSA and LDA at fixed topic counts, with windowed coherence."""

from __future__ import annotations

import logging
from dataclasses import dataclass
from typing import Iterable

from pyspark.sql import DataFrame, functions as F

from reviewlens import settings
from reviewlens.functions.text import fixed_tokens
from reviewlens.operators import quality, topic_words
from reviewlens.operators.lda import fit_lda_passes
from reviewlens.operators.svd import fit_lsa
from reviewlens.operators.topic_model import TopicModel, topic_export
from reviewlens.operators.vocabulary import FeatureSpace, trimmed_dictionary
from reviewlens.sources import results

log = logging.getLogger(__name__)


@dataclass
class FixedInput:
    keys: list[str]
    tokens: DataFrame
    counts: FeatureSpace
    tfidf: FeatureSpace


def fixed_input(tokens_df: DataFrame, keys: list[str], **limits) -> FixedInput | None:
    """Dictionary and both vector spaces; None when no known word is left."""
    tokens_df = tokens_df.persist()
    dictionary = trimmed_dictionary(tokens_df, **limits).persist()
    documents = tokens_df.count()
    counts = FeatureSpace(dictionary, documents, "count")
    if not counts.terms:
        return None
    return FixedInput(keys, tokens_df, counts, FeatureSpace(dictionary, documents, "log2"))


def fit_fixed(data: FixedInput, method: str, k: int, **options) -> TopicModel:
    """LSA on TF-IDF with at most one topic per word, LDA on counts."""
    space = data.tfidf if method == "lsa" else data.counts
    features = space.transform(data.tokens).select(*data.keys, "features").persist()
    try:
        if method == "lsa":
            return fit_lsa(features, min(k, len(space.terms)), space.terms, **options)
        return fit_lda_passes(features, k, space.terms, **options)
    finally:
        features.unpersist()


def coherence(data: FixedInput, model: TopicModel) -> DataFrame:
    """C_v per topic over its 20 strongest words."""
    terms = model.topic_terms(data.tokens.sparkSession, settings.COHERENCE_WORDS, absolute=model.method == "lsa")
    return quality.window_coherence(data.tokens, terms.select("topic", "term"))


def export(data: FixedInput, model: TopicModel) -> DataFrame:
    """Ten words per topic; LSA words are ranked by absolute weight."""
    return topic_export(model, data.tokens.sparkSession, absolute=model.method == "lsa")


def run_fixed(
    reviews: DataFrame,
    text: str,
    keys: list[str],
    base: str,
    methods: Iterable[str] = ("lsa", "lda"),
    counts: Iterable[int] = settings.FIXED_TOPIC_COUNTS,
) -> list[dict]:
    """All methods and counts; a failing run is a row with its ``reason`` and the others go on."""
    data = fixed_input(fixed_tokens(reviews.dropna(subset=[text]), text, keys), keys)
    if data is None:
        log.error("no known words left after normalisation")
        return []
    done = []
    for method in methods:
        for k in counts:
            try:
                model = fit_fixed(data, method, k)
                score = coherence(data, model).agg(F.avg("c_v")).head()[0]
                path = results.write_topic_words(export(data, model), base, method, k)
                done.append({"method": method, "n_topics": k, "c_v": score, "path": path, "reason": None})
            except Exception as error:
                log.exception("%s with %d topics failed", method, k)
                done.append({"method": method, "n_topics": k, "c_v": None, "path": None, "reason": str(error)})
    return done
