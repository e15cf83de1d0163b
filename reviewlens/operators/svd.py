"""LSA: truncated SVD of a sparse document matrix in a few passes.

Randomised subspace iteration (Halko, Martinsson, Tropp 2011): a V x (K+extra)
block is multiplied by X'X once per round.  The block is sized by the model and
sent to the tasks; documents never leave their partition.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from reviewlens import settings
from reviewlens.operators.matrix import fold, row_arrays, times, transpose_times
from reviewlens.operators.topic_model import TopicModel


#: Most passes of a fit, and the share by which squared singular values may still move at its end.
ROUNDS, TOLERANCE = 20, 1e-7


class LsaModel(TopicModel):
    method = "lsa"

    def __init__(self, components, terms, singular_values):
        super().__init__(components, terms)
        self.singular_values = singular_values
        self.explained_variance_ratio = None

    def transform(self, features: DataFrame, keys: list[str], column: str = "features") -> DataFrame:
        basis = self.components.T.copy()
        shared = features.sparkSession.sparkContext.broadcast(basis)
        return row_arrays(
            features, column, keys, basis.shape[1], lambda i, v, s: times(i, v, s, shared.value), "distribution"
        )

    def explain(self, features: DataFrame, column: str = "features") -> np.ndarray:
        """Variance of each score column over the total variance of the terms."""
        basis = self.components.T.copy()
        shared = features.sparkSession.sparkContext.broadcast(basis)
        width, k = basis.shape

        def start():
            return {"n": np.zeros(1), "x": np.zeros(width), "xx": np.zeros(width), "y": np.zeros(k), "yy": np.zeros(k)}

        def step(totals, indices, values, starts):
            scores = times(indices, values, starts, shared.value)
            totals["n"] += len(starts) - 1
            totals["x"] += np.bincount(indices, values, width)
            totals["xx"] += np.bincount(indices, values * values, width)
            totals["y"] += scores.sum(axis=0)
            totals["yy"] += (scores * scores).sum(axis=0)

        sums = fold(features.select(column), k, start, step)
        n = sums["n"][0]
        score_var = sums["yy"] / n - (sums["y"] / n) ** 2
        total_var = (sums["xx"] / n - (sums["x"] / n) ** 2).sum()
        self.explained_variance_ratio = score_var / total_var
        return self.explained_variance_ratio

    def performance(self, features: DataFrame, column: str = "features") -> float:
        return float(self.explain(features, column).sum())

    def importance(self) -> np.ndarray:
        if self.explained_variance_ratio is None:
            return self.singular_values**2
        return np.abs(self.explained_variance_ratio)

    def leading(self, k: int) -> "LsaModel":
        """The model of the first ``k`` components: those of a larger fit are the same."""
        return LsaModel(self.components[:k], self.terms, self.singular_values[:k])

    def refit(self, features: DataFrame, column: str = "features") -> "LsaModel":
        return fit_lsa(features, self.k, self.terms, column)


class Subspace:
    """A block of vectors on its way to the K leading right singular vectors."""

    def __init__(self, width: int, k: int, seed: int, tolerance: float, extra: int = 10):
        self.k, self.tolerance = min(k, width), tolerance
        block = min(self.k + extra, width)
        self.basis, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, block)))
        self.leading, self.right, self.settled = None, None, False

    def take(self, product: np.ndarray, last: bool = False) -> None:
        """Use X'X times the basis; settled when no leading value moves any more, or at the last."""
        small = self.basis.T @ product
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(values)[::-1][: self.k]
        before, self.leading = self.leading, values[order]
        self.right = (self.basis @ vectors[:, order]).T
        close = before is not None and np.allclose(self.leading, before, rtol=self.tolerance, atol=1e-12 * self.leading.max(initial=0.0))
        self.settled = close or last
        if not self.settled:
            self.basis, _ = np.linalg.qr(product)

    def model(self, terms: list[str]) -> LsaModel:
        """The largest entry of each vector is made positive."""
        peak = np.argmax(np.abs(self.right), axis=1)
        signs = np.where(self.right[np.arange(len(self.right)), peak] < 0, -1.0, 1.0)
        return LsaModel(self.right * signs[:, None], terms, np.sqrt(np.maximum(self.leading, 0)))


def fit_lsa(
    features: DataFrame,
    k: int,
    terms: list[str],
    column: str = "features",
    rounds: int = ROUNDS,
    tolerance: float = TOLERANCE,
    extra: int = 10,
    seed: int = settings.SEED,
) -> LsaModel:
    """K right singular vectors; the largest entry of each is made positive.

    A round is one pass over the documents.  The rounds end when none of the K squared
    singular values moves by more than ``tolerance`` of itself, or after ``rounds``.
    """
    space = Subspace(len(terms), k, seed, tolerance, extra)
    rows = features.select(column)
    context = features.sparkSession.sparkContext

    def gram_times(q):
        shared = context.broadcast(q)

        def step(totals, indices, values, starts):
            transpose_times(indices, values, starts, times(indices, values, starts, shared.value), totals["z"])

        product = fold(rows, q.shape[1], lambda: {"z": np.zeros(q.shape)}, step)["z"]
        shared.destroy()  # unpersist would keep a copy on the driver for each pass
        return product

    for left in reversed(range(rounds)):
        space.take(gram_times(space.basis), last=not left)
        if space.settled:
            break
    return space.model(terms)
