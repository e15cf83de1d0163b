"""Steps, softmax and row sums of the recurrent model against plain ones."""

import numpy as np

from reviewlens.llm import recurrent_lm
from reviewlens.llm.recurrent_lm import HIDDEN, PER_CLASS, SHAPES, WORDS, GatedModel


def some_model(seed):
    model = GatedModel.from_counts(np.arange(WORDS, 0, -1).astype(float), 50.0)
    make = np.random.default_rng(seed)
    for name in ("embed", "enter", "gates", "candidate", "class_weight", "word_weight"):
        getattr(model, name)[:] = make.normal(0, 0.3, SHAPES[name])
    return model


def plain_score(model, document, first):
    h, total, before = np.zeros(HIDDEN), 0.0, first
    for word in document:
        x = model.embed[before] @ model.enter + model.bias
        gates = 1 / (1 + np.exp(-x[: 2 * HIDDEN] - h @ model.gates))
        c = np.tanh(x[2 * HIDDEN :] + (gates[HIDDEN:] * h) @ model.candidate)
        h = h + gates[:HIDDEN] * (c - h)
        k, slot = divmod(int(word), PER_CLASS)
        odds = np.exp(h @ model.class_weight + model.class_bias)
        total += np.log(odds[k] / odds.sum())
        if word < WORDS:
            odds = np.exp(h @ model.word_weight[k] + model.word_bias[k])
            total += np.log(odds[slot] / odds.sum())
        before = word
    return total


def test_scores_of_documents_of_all_lengths():
    model, make = some_model(1), np.random.default_rng(2)
    documents = [make.integers(0, WORDS + 1, size) for size in (150, 150, 70, 64, 9, 3, 1, 0)]
    expected = [plain_score(model, document, 3) for document in documents]
    assert np.allclose(model.score(documents, 3), expected, rtol=1e-4)


def test_training_loops_over_no_class_with_few_calls(monkeypatch):
    model, make = some_model(1), np.random.default_rng(2)
    calls = []
    plain = np.exp
    monkeypatch.setattr(recurrent_lm.np, "exp", lambda *args, **more: calls.append(1) or plain(*args, **more))
    model.log_probability(make.normal(0, 1, (500, HIDDEN)).astype(np.float32), make.integers(0, WORDS + 1, 500))
    assert len(calls) == 2  # of classes and of words; once for each class before
