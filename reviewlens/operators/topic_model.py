"""What all fitted topic models share: a small topic-term matrix with its terms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from reviewlens import settings


class TopicModel:
    """Topics x terms matrix (bounded by K and the vocabulary cap) plus terms."""

    method = ""

    def __init__(self, components: np.ndarray, terms: list[str]):
        self.components = np.asarray(components, dtype=float)
        self.terms = list(terms)

    @property
    def k(self) -> int:
        return self.components.shape[0]

    def weights(self) -> np.ndarray:
        """The matrix topics are ranked and compared by."""
        return self.components

    def importance(self) -> np.ndarray:
        return self.weights().sum(axis=1)

    def topic_terms(self, spark: SparkSession, n: int | None = None, absolute: bool = False) -> DataFrame:
        """(topic, term, weight); only the n strongest per topic when n is given."""
        import pandas as pd

        weights, names = self.weights(), np.array(self.terms, dtype=object)
        by_name = np.argsort(np.argsort(names.astype(str)))
        frames = []
        for topic, row in enumerate(weights):
            strength = np.abs(row) if absolute else row
            chosen = np.lexsort((by_name, -strength))[:n] if n else np.arange(len(row))
            frames.append(pd.DataFrame({"topic": topic, "term": names[chosen], "weight": row[chosen]}))
        table = pd.concat(frames, ignore_index=True)
        return spark.createDataFrame(table, "topic int, term string, weight double")

    def topic_importance(self, spark: SparkSession) -> DataFrame:
        rows = [(i, float(v)) for i, v in enumerate(self.importance())]
        return spark.createDataFrame(rows, "topic int, importance double")

    def transform(self, features: DataFrame, keys: list[str], column: str = "features") -> DataFrame:
        """(keys, distribution): the document's weight on every topic."""
        raise NotImplementedError

    def performance(self, features: DataFrame, column: str = "features") -> float:
        raise NotImplementedError

    def refit(self, features: DataFrame, column: str = "features") -> "TopicModel":
        """Same model on other rows, with the library-default effort."""
        raise NotImplementedError


def topic_export(model: TopicModel, spark: SparkSession, n: int = settings.TOP_WORDS, absolute: bool = False) -> DataFrame:
    """(topic_id, words[n], scores[n]) for every topic."""
    from reviewlens.operators.topic_words import top_words, topic_details

    terms = model.topic_terms(spark, n, absolute)
    return topic_details(top_words(terms, n, absolute), keep_outlier=True).orderBy("topic_id")


def best_match_mean(first: TopicModel, second: TopicModel) -> float:
    """Mean over the first model's topics of the best cosine in the second."""

    def unit(matrix):
        length = np.linalg.norm(matrix, axis=1, keepdims=True)
        return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)

    return float((unit(first.weights()) @ unit(second.weights()).T).max(axis=1).mean())


def stability(
    model: TopicModel,
    features: DataFrame,
    keys: list[str],
    column: str = "features",
    runs: int = settings.STABILITY_RUNS,
    share: float = settings.STABILITY_SHARE,
    again: list[TopicModel] | None = None,
) -> float:
    """Mean best match between the model and refits on hash samples of the rows.

    ``again`` holds the refits where they were made together with the model.
    """
    from reviewlens.operators.sampling import share_sample

    if again is None:
        again = [model.refit(share_sample(features, share, keys, seed=run), column) for run in range(runs)]
    return float(np.mean([best_match_mean(model, other) for other in again]))


def first_max_topics(model: TopicModel, features: DataFrame, keys: list[str], column: str = "features") -> DataFrame:
    """(keys, topic, strength): dominant topic of each row."""
    from reviewlens.operators.assignment import dominant_topic

    spread = model.transform(features, keys, column)
    return dominant_topic(spread).withColumn("strength", F.array_max("distribution"))
