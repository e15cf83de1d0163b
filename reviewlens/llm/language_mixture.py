"""Language identification as a mixture of languages in each document.

Every language has a smoothed distribution over hashed letter trigrams, counted over
all training documents.  A document's trigrams are seen as drawn from a mixture of
those distributions; expectation-maximisation estimates the proportions.  A set of
languages is scored by its log-likelihood less a penalty for each language beyond
the first: starting from the best single language, languages are added while the
score rises, and the proportions of the chosen set are the answer.

The log-likelihood is concave in the proportions, so what any mixture can gain over
the best single language is at most the largest derivative towards another language;
where that bound is below the penalty no mixture is fitted.

Edge cases: a null text, or one without letters, is ``und`` with score 0 and no
proportions; rows with a null language only don't train; a null id counts as the
empty text when rows are divided; without any training row every text is ``und``;
repeated rows are predicted each; ties go to the language that sorts first; other
columns are passed through only by ``identified``.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from reviewlens.llm.common import id_bucket, keep_rows, map_texts

#: Bins that trigrams are hashed to; the model has bins x languages numbers.
BINS = 1 << 17
#: Languages are few by nature; more labels than this are an error in the data.
MOST_LANGUAGES = 1000
SMOOTHING = 0.05
#: Log-likelihood, in nats, that another language has to gain: a constant part and
#: a part for each trigram of the document.
PENALTY, PENALTY_SHARE = 6.0, 0.02
ROUNDS = 25
#: Bytes whose trigrams are held at once.
BLOCK_BYTES = 1 << 20

#: Letters a-z are 1-26, bytes of other characters 27-154, all else a boundary.
SYMBOL = np.array(
    [b - 96 if 97 <= b <= 122 else b - 101 if b >= 128 else 0 for b in range(256)], dtype=np.int64
)


def trigrams(text: str) -> np.ndarray:
    """Hashed bins of the trigrams of a text; runs of other characters are one boundary."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass") + b" ", np.uint8)
    codes = SYMBOL[raw]
    keep = codes > 0
    keep[1:] |= codes[:-1] > 0  # the first character of a run stays, as its boundary
    codes = codes[keep]
    if not codes.any():
        return np.empty(0, np.int64)
    if codes[0]:
        codes = np.concatenate(([0], codes))
    grams = (codes[:-2] * 155 + codes[1:-1]) * 155 + codes[2:]
    return (grams * 0x9E3779B1 >> 7) % BINS


def _training_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: dict[str, np.ndarray] = {}
    texts: dict[str, list[str]] = {}

    def add(lang: str, waiting: list[str]) -> None:
        total = counts.setdefault(lang, np.zeros(BINS, np.int64))
        joined = "\n".join(waiting)
        for at in range(0, len(joined), BLOCK_BYTES):
            total += np.bincount(trigrams(joined[at : at + BLOCK_BYTES]), minlength=BINS)
        waiting.clear()

    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"]):
            waiting = texts.setdefault(lang, [])
            waiting.append(text)
            if sum(map(len, waiting)) >= BLOCK_BYTES // 4:
                add(lang, waiting)
    for lang, waiting in texts.items():
        add(lang, waiting)
    for lang, total in counts.items():
        bins = np.flatnonzero(total)
        yield pd.DataFrame({"lang": lang, "bin": bins, "n": total[bins]})


class Model:
    """Log-probability of each bin in each language."""

    def __init__(self, languages: list[str], log_probability: np.ndarray):
        self.languages = languages
        self.log_p = log_probability  # bins x languages, float32
        self.p = np.exp(log_probability)

    def predict(self, text: str | None) -> tuple[str, float, dict[str, float]]:
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return "und", 0.0, {}
        grams = np.concatenate([trigrams(text[at : at + BLOCK_BYTES]) for at in range(0, len(text), BLOCK_BYTES)])
        if not len(grams):
            return "und", 0.0, {}
        shares = self.mixture(*np.unique(grams, return_counts=True))
        best = int(np.argmax(shares))
        named = {self.languages[i]: float(shares[i]) for i in np.flatnonzero(shares > 0)}
        return self.languages[best], float(min(1.0, shares[best])), named

    def mixture(self, bins: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Proportions of the languages of the set with the best penalised likelihood."""
        log_p, n = self.log_p[bins], counts.sum()
        single = counts @ log_p
        chosen = [int(np.argmax(single))]
        score = float(single[chosen[0]])
        shares = np.zeros(len(self.languages))
        shares[chosen[0]] = 1.0
        penalty = PENALTY + PENALTY_SHARE * float(n)
        p = None
        while len(chosen) < len(self.languages):
            p = self.p[bins].astype(np.float64) if p is None else p
            mixed = p @ shares
            # derivative towards each language: an upper bound of what adding it gains
            bound = (counts / mixed) @ p - n
            bound[chosen] = -np.inf
            best = None
            for added in np.argsort(-bound, kind="stable"):
                if bound[added] <= penalty or (best and best[0] >= bound[added]):
                    break
                tried = [*chosen, int(added)]
                part, likelihood = self._fit(p[:, tried], counts, n)
                if best is None or likelihood - score > best[0]:
                    best = (likelihood - score, tried, part)
            if best is None or best[0] <= penalty:
                break
            score += best[0]
            chosen = best[1]
            shares = np.zeros(len(self.languages))
            shares[chosen] = best[2]
        return shares

    @staticmethod
    def _fit(p: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, float]:
        """Expectation-maximisation of the proportions of a given set."""
        part = np.full(p.shape[1], 1.0 / p.shape[1])
        for _ in range(ROUNDS):
            before = part
            part = part * ((counts / (p @ part)) @ p) / n
            if np.abs(part - before).max() < 1e-4:
                break
        return part, float(counts @ np.log(p @ part))


def train(documents: DataFrame) -> Model:
    """Counts over all given documents whose language is known.

    Only bins x languages sums reach the driver, whatever the number of documents.
    """
    rows = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")
    )
    sums = rows.mapInPandas(_training_counts, "lang string, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    totals = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("bins")).limit(MOST_LANGUAGES + 1)
    found = sorted(((r["lang"], r["bins"]) for r in totals.toLocalIterator()), key=lambda x: x[0])
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} language labels")
    log_p = np.zeros((BINS, len(found)), np.float32)
    for column, (_, pairs) in enumerate(found):
        counts = np.zeros(BINS)
        bins, n = np.array(pairs, dtype=np.int64).T
        counts[bins] = n
        log_p[:, column] = np.log((counts + SMOOTHING) / (counts.sum() + SMOOTHING * BINS))
    return Model([lang for lang, _ in found], log_p)


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score, shares`` of every document."""
    sent = documents.sparkSession.sparkContext.broadcast((model.languages, model.log_p))

    def build():
        known = Model(*sent.value)

        def step(texts):
            found = [known.predict(t) for t in texts]
            return {
                "lang_pred": [f[0] for f in found],
                "score": [f[1] for f in found],
                "shares": [list(f[2].items()) for f in found],
            }

        return step

    return map_texts(documents, build, "lang_pred string, score double, shares map<string,double>")


def identified(documents: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The documents, with all their columns, whose main language has at least that share."""
    sent = documents.sparkSession.sparkContext.broadcast((model.languages, model.log_p))

    def build():
        known = Model(*sent.value)
        return lambda texts: [lang != "und" and score >= least for lang, score, _ in map(known.predict, texts)]

    return keep_rows(documents, build)


def training_rows(documents: DataFrame) -> DataFrame:
    """Two thirds of the documents, by their id; the rest is held out."""
    return documents.where(id_bucket(F.col("doc_id"), 3) != 1)


def held_out(column="doc_id"):
    return id_bucket(F.col(column), 3) == 1
