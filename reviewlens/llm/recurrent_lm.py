"""Document log-likelihood by a gated recurrent language model in numpy.

Tokens are words; every document ends with one end token.  The model is a GRU over
the most frequent words and one stand-in for all others.  Its softmax has two parts:
the class of the next word, then the word within the class.  A word beyond the
model's vocabulary has the stand-in's probability times its smoothed share among all
such words, so the whole is a distribution over words, unseen ones as one outcome.

Training: counts of all words of all training documents set the vocabulary, the
classes and the output biases.  The weights are then trained by truncated
backpropagation through time, in rounds: each partition trains a copy on its share of
the round's documents, and the copies are averaged by Spark; every training document is
in one round, chosen by its id.  Scoring reads whole documents window by
window and carries the state from one window to the next.

A table of the most frequent words, of bounded size, is broadcast; counts of the other
words of a document are joined.

Edge cases: a null or empty text is the end token alone; a null id counts as the empty
text when documents are divided; without training rows every token has probability
one; repeated rows are scored each; other columns are dropped.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from reviewlens.llm.common import checkpointed, id_bucket, space_words

#: The end token; no word holds a line feed.
END = b"\n"
#: Words of the model: classes x words of a class.
CLASSES, PER_CLASS = 32, 32
WORDS = CLASSES * PER_CLASS
#: Most words whose counts are broadcast (about 8 MB).
FREQUENT = 1 << 18
#: Words counted in a task before they are handed over.
HELD_WORDS = 1_000_000
EMBEDDING, HIDDEN = 16, 16
#: Steps of a window, documents of a batch, for scoring and for training.
SCORE_WINDOW, SCORE_BATCH = 64, 256
TRAIN_WINDOW, TRAIN_BATCH = 32, 64
#: Rounds of training; each training document is in one of them.
ROUNDS = 4
LEARNING_RATE, CLIP = 0.004, 5.0
ADD = 0.1

SHAPES = {
    "embed": (WORDS + 1, EMBEDDING), "enter": (EMBEDDING, 3 * HIDDEN), "gates": (HIDDEN, 2 * HIDDEN),
    "candidate": (HIDDEN, HIDDEN), "bias": (3 * HIDDEN,), "class_weight": (HIDDEN, CLASSES + 1),
    "class_bias": (CLASSES + 1,), "word_weight": (CLASSES, HIDDEN, PER_CLASS), "word_bias": (CLASSES, PER_CLASS),
}
PARAMETERS = sum(math.prod(s) for s in SHAPES.values())
ABSENT = -1e9


def _log_shares(logits: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logarithm of the share of column ``at`` in each row, and the shares, which replace the logits."""
    logits -= logits.max(axis=1, keepdims=True)
    found = logits[np.arange(len(at)), at]
    np.exp(logits, out=logits)
    total = logits.sum(axis=1)
    logits /= total[:, None]
    return found - np.log(total), logits


class GatedModel:
    """Word ``i`` is in class ``i // PER_CLASS``; word ``WORDS`` stands for all others."""

    def __init__(self, flat: np.ndarray):
        self.flat = flat.astype(np.float32)
        at = 0
        for name, shape in SHAPES.items():
            size = math.prod(shape)
            setattr(self, name, self.flat[at : at + size].reshape(shape))
            at += size

    @classmethod
    def from_counts(cls, counts: np.ndarray, others: float) -> "GatedModel":
        """Small fixed weights; biases say the frequencies of words and classes."""
        start = np.random.default_rng(7).normal(0, 0.1, PARAMETERS)
        model = cls(start)
        model.bias[:] = 0
        model.class_weight[:] = 0
        model.word_weight[:] = 0
        full = np.zeros(WORDS)
        full[: len(counts)] = counts
        by_class = full.reshape(CLASSES, PER_CLASS)
        with np.errstate(divide="ignore"):
            model.word_bias[:] = np.maximum(np.log(by_class), ABSENT)
            model.class_bias[:] = np.maximum(np.log(np.append(by_class.sum(axis=1), others)), ABSENT)
        return model

    def steps(self, x: np.ndarray, h: np.ndarray, live: list[int], kept: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(states after each step of the first ``live`` rows, the last ones); ``x`` from a table of ``enter_table``."""
        half = 0.5 * self.gates  # sigmoid(x) is (tanh(x / 2) + 1) / 2
        states = np.zeros((len(x), x.shape[1], HIDDEN), np.float32)
        for t, n in enumerate(live):
            now, before = x[t, :n], h[:n]
            gates = before @ half
            gates += now[:, : 2 * HIDDEN]
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            c = (r * before) @ self.candidate
            c += now[:, 2 * HIDDEN :]
            np.tanh(c, out=c)
            after = np.subtract(c, before, out=states[t, :n])
            after *= z
            after += before
            h = after if n == len(h) else np.concatenate([after, h[n:]])
            if kept is not None:
                kept.append((before, gates, c))
        return states, h

    def enter_table(self) -> np.ndarray:
        """What each word adds to the gates, halved, and to the candidate."""
        table = self.embed @ self.enter + self.bias
        table[:, : 2 * HIDDEN] *= 0.5
        return table

    def log_probability(self, states: np.ndarray, targets: np.ndarray, gradient: dict | None = None):
        """Natural log-probability of each target; with ``gradient`` also d(-sum)/d(states)."""
        classes = targets // PER_CLASS
        order = np.argsort(classes, kind="stable")
        cuts = np.searchsorted(classes[order], np.arange(CLASSES + 1)).tolist()
        parts = [(k, slice(low, high)) for k, (low, high) in enumerate(zip(cuts, cuts[1:])) if low < high]
        order = order[: cuts[-1]]  # the stand-in is alone in its class
        result, odds = _log_shares(states @ self.class_weight + self.class_bias, classes)
        sorted_states, slots = states.take(order, 0), targets[order] % PER_CLASS
        inside = np.empty((len(order), PER_CLASS), states.dtype)
        for k, part in parts:
            np.matmul(sorted_states[part], self.word_weight[k], out=inside[part])
        inside += self.word_bias.take(classes[order], 0)
        found, within = _log_shares(inside, slots)
        result[order] += found
        if gradient is None:
            return result
        odds[np.arange(len(targets)), classes] -= 1
        within[np.arange(len(order)), slots] -= 1
        gradient["class_weight"] += states.T @ odds
        gradient["class_bias"] += odds.sum(axis=0)
        back, turned = odds @ self.class_weight.T, np.empty_like(sorted_states)
        for k, part in parts:
            gradient["word_weight"][k] += sorted_states[part].T @ within[part]
            gradient["word_bias"][k] += within[part].sum(axis=0)
            np.matmul(within[part], self.word_weight[k].T, out=turned[part])
        back[order] += turned
        return result, back

    def score(self, documents: list[np.ndarray], first: int) -> np.ndarray:
        """Natural log-probability of each document, a list of word numbers."""
        totals = np.zeros(len(documents))
        order = sorted(range(len(documents)), key=lambda i: -len(documents[i]))
        table = self.enter_table()
        for at in range(0, len(order), SCORE_BATCH):
            part = order[at : at + SCORE_BATCH]
            totals[part] = self._score_batch([documents[i] for i in part], table, first)
        return totals

    def _score_batch(self, documents: list[np.ndarray], table: np.ndarray, first: int) -> np.ndarray:
        totals = np.zeros(len(documents))
        h = np.zeros((len(documents), HIDDEN), np.float32)
        for block, inputs, live, mask in _windows(documents, first, SCORE_WINDOW):
            active = block.shape[1]
            states, h = self.steps(table.take(inputs, 0), h[:active], live.tolist())
            found = self.log_probability(states[mask], block[mask])
            totals[:active] += np.bincount(np.nonzero(mask)[1], weights=found, minlength=active)
        return totals

    def train(self, documents: list[np.ndarray], first: int, optimiser: "Adam") -> None:
        """Truncated backpropagation over windows; the state is carried between them."""
        order = sorted(range(len(documents)), key=lambda i: -len(documents[i]))
        for at in range(0, len(order), TRAIN_BATCH):
            part = [documents[i] for i in order[at : at + TRAIN_BATCH]]
            h = np.zeros((len(part), HIDDEN), np.float32)
            for block, inputs, live, mask in _windows(part, first, TRAIN_WINDOW):
                h = self._train_window(h[: block.shape[1]], block, inputs, mask, optimiser)

    def _train_window(self, h, block, inputs, mask, optimiser):
        gradient = {name: np.zeros(shape, np.float32) for name, shape in SHAPES.items()}
        x = self.enter_table().take(inputs, 0)
        kept: list = []
        states, last = self.steps(x, h, [len(h)] * len(block), kept)
        _, back = self.log_probability(states[mask], block[mask], gradient)
        outward = np.zeros_like(states)
        outward[mask] = back
        before, gates, c = (np.stack(column) for column in zip(*kept))
        z, r = gates[:, :, :HIDDEN], gates[:, :, HIDDEN:]
        # factors of the loop, for all steps at once; multiplied in one order, so that rounding is the same
        bent, change, unset, stay = 1 - c * c, c - before, 1 - r, 1 - z
        entered = np.empty_like(x)
        dh = np.zeros_like(h)
        for t in reversed(range(len(block))):
            now = entered[t]
            dh += outward[t]
            dc = dh * z[t]
            dc *= bent[t]
            into = dc @ self.candidate.T
            dz, dr = dh * change[t], into * before[t]
            dz *= z[t]
            dr *= r[t]
            np.multiply(dz, stay[t], out=now[:, :HIDDEN])
            np.multiply(dr, unset[t], out=now[:, HIDDEN : 2 * HIDDEN])
            now[:, 2 * HIDDEN :] = dc
            dh *= stay[t]
            into *= r[t]
            dh += into
            dh += np.ascontiguousarray(now[:, : 2 * HIDDEN]) @ self.gates.T
        # step by step from the last one on: the order of a running sum
        by_step = lambda values, turned: np.matmul(values.transpose(0, 2, 1), np.ascontiguousarray(turned))[::-1].sum(axis=0)
        gradient["candidate"] += by_step(r * before, entered[:, :, 2 * HIDDEN :])
        gradient["gates"] += by_step(before, entered[:, :, : 2 * HIDDEN])
        flat, words = entered.reshape(-1, 3 * HIDDEN), inputs.ravel()
        gradient["enter"] += self.embed.take(words, 0).T @ flat
        gradient["bias"] += flat.sum(axis=0)
        np.add.at(gradient["embed"], words, flat @ self.enter.T)
        optimiser.update(self.flat, np.concatenate([g.ravel() for g in gradient.values()]) / mask.sum())
        return last


def _windows(documents: list[np.ndarray], first: int, steps: int):
    """(targets, inputs, live documents at each step, mask) of documents sorted by falling length."""
    lengths = np.array([len(d) for d in documents])
    last = np.full(len(documents), first, np.int64)
    for at in range(0, int(lengths.max(initial=0)), steps):
        active = int((lengths > at).sum())
        size = min(steps, int(lengths[0]) - at)
        block = np.full((size, active), WORDS, np.int64)
        for i in range(active):
            piece = documents[i][at : at + size]
            block[: len(piece), i] = piece
        live = (lengths[None, :active] > at + np.arange(size)[:, None]).sum(axis=1)
        mask = np.arange(active)[None, :] < live[:, None]
        inputs = np.concatenate([last[None, :active], block[:-1]])
        yield block, inputs, live, mask
        last[:active] = block[-1]


class Adam:
    def __init__(self):
        self.mean, self.square, self.time = np.zeros(PARAMETERS, np.float32), np.zeros(PARAMETERS, np.float32), 0

    def update(self, values: np.ndarray, gradient: np.ndarray) -> None:
        norm = float(np.linalg.norm(gradient))
        if not math.isfinite(norm):
            return
        gradient = gradient * min(1.0, CLIP / max(norm, 1e-9))
        self.time += 1
        self.mean += 0.1 * (gradient - self.mean)
        self.square += 0.01 * (gradient * gradient - self.square)
        rate = LEARNING_RATE * math.sqrt(1 - 0.99**self.time) / (1 - 0.9**self.time)
        values -= rate * self.mean / (np.sqrt(self.square) + 1e-6)


def word_counts(documents: DataFrame) -> DataFrame:
    """(word, n) over all given documents, the end token included."""

    def run(batches):
        counts: Counter = Counter()

        def rows():
            batch = pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"]
            )
            counts.clear()
            return batch

        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(space_words(text))
                counts[END] += 1
                if len(counts) >= HELD_WORDS:
                    yield rows()
        if counts:
            yield rows()

    parts = documents.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word binary, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """The frequent words with their counts, most frequent first, and the totals."""

    def __init__(self, words: list[bytes], counts: np.ndarray, tokens: int, distinct: int):
        self.words, self.counts, self.tokens, self.distinct = words, counts, tokens, distinct
        inside = counts[:WORDS]
        self.other_tokens = tokens - int(inside.sum())
        self.other_words = distinct - len(inside)
        self.base_norm = tokens + ADD * (distinct + 1)
        self.other_norm = self.other_tokens + ADD * (self.other_words + 1)

    def model(self) -> GatedModel:
        return GatedModel.from_counts(self.counts[:WORDS], self.other_norm)

    def numbers(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words)}

    def first(self) -> int:
        """The input before the first word: the end token."""
        at = self.words[:WORDS].index(END) if END in self.words[:WORDS] else WORDS
        return at


def frequent_words(counts: DataFrame) -> Vocabulary:
    """At most ``FREQUENT`` words: all those above a count that is found from a small histogram."""
    tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    level = F.floor(8 * F.log2(F.col("n").cast("double"))).cast("int")
    held, least = 0, None
    for row in sorted(counts.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        held += row["count"]
        if held > FREQUENT:
            break
        least = row["level"]
    rows = [] if least is None else counts.where(level >= least).collect()
    rows.sort(key=lambda r: (-r["n"], bytes(r["word"])))
    return Vocabulary([bytes(r["word"]) for r in rows], np.array([r["n"] for r in rows], np.float64), int(tokens), int(distinct))


def _model_words(words: list[bytes], numbers: dict[bytes, int]) -> np.ndarray:
    found = np.fromiter(map(numbers.get, words, repeat(WORDS)), np.int64, len(words))
    return np.minimum(found, WORDS)


def of_round(documents: DataFrame, number: int) -> DataFrame:
    """The documents of a round, by their id; null ids are in one round as well."""
    return documents.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(ROUNDS)) == number)


def train(documents: DataFrame, vocabulary: Vocabulary) -> GatedModel:
    """Rounds of training on every partition, averaged by the number of tokens."""
    context = documents.sparkSession.sparkContext
    model = vocabulary.model()
    small = Vocabulary(vocabulary.words[:WORDS], vocabulary.counts[:WORDS], vocabulary.tokens, vocabulary.distinct)
    for number in range(ROUNDS):
        sent = context.broadcast((model.flat, small.words, small.first()))

        def run(batches, sent=sent):
            flat, words, first = sent.value
            mine, optimiser, tokens = GatedModel(flat.copy()), Adam(), 0
            numbers = {w: i for i, w in enumerate(words)}
            for batch in batches:
                parts = [_model_words([*space_words(t), END], numbers) for t in batch.column(0).to_pylist()]
                mine.train(parts, first, optimiser)
                tokens += sum(map(len, parts))
            if tokens:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(PARAMETERS)), pa.array(mine.flat.astype(np.float64) * tokens), pa.array(np.full(PARAMETERS, tokens, np.int64))],
                    ["at", "value", "tokens"],
                )

        copies = of_round(documents, number).select(F.col("text").cast("string").alias("text")).mapInArrow(run, "at long, value double, tokens long")
        mean = copies.groupBy("at").agg((F.sum("value") / F.sum("tokens")).alias("value")).collect()
        if mean:
            flat = np.empty(PARAMETERS)
            flat[[r["at"] for r in mean]] = [r["value"] for r in mean]
            model = GatedModel(flat)
    return model


SCORED = (
    "doc_id long, n_tokens long, known long, base double, score double, rare array<binary>, times array<long>"
)


def score(documents: DataFrame, counts: DataFrame, vocabulary: Vocabulary, model: GatedModel) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` (base-10 logarithms)."""
    plain = (vocabulary.words, vocabulary.counts, vocabulary.tokens, vocabulary.distinct)
    sent = documents.sparkSession.sparkContext.broadcast((plain, model.flat))

    def run(batches):
        plain, flat = sent.value
        known_words = Vocabulary(*plain)
        net, numbers, first = GatedModel(flat), known_words.numbers(), known_words.first()
        base = np.log10((known_words.counts + ADD) / known_words.base_norm)
        other = np.log10((known_words.counts + ADD) / known_words.other_norm)
        other[:WORDS] = 0
        for batch in batches:
            texts = batch.column(1).to_pylist()
            documents, rows = [], []
            for text in texts:
                words = [*space_words(text), END]
                found = np.fromiter(map(numbers.get, words, repeat(-1)), np.int64, len(words))
                rare = Counter(words[i] for i in np.flatnonzero(found < 0))
                inside = found[found >= 0]
                rows.append((len(words), len(inside), float(base[inside].sum()), float(other[inside].sum()), list(rare), list(rare.values())))
                found[found < 0] = WORDS
                documents.append(np.minimum(found, WORDS))
            likely = net.score(documents, first) / math.log(10)
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64()),
                    pa.array(likely + np.array(columns[3])), pa.array(columns[4], pa.list_(pa.binary())), pa.array(columns[5], pa.list_(pa.int64())),
                ],
                [field.split()[0] for field in SCORED.split(", ")],
            )

    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = checkpointed(slim.mapInArrow(run, SCORED).withColumn("row", F.monotonically_increasing_id()))
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select(
        "row", F.col("r.rare").alias("word"), F.col("r.times").alias("times")
    )
    n = F.coalesce(F.col("n"), F.lit(0))
    part = lambda norm: F.sum(F.col("times") * F.log10((n + ADD) / F.lit(norm)))
    sums = rare.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("more"),
        part(vocabulary.base_norm).alias("more_base"), part(vocabulary.other_norm).alias("more_score"),
    )
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    return scored.join(sums, "row", "left").select(
        "doc_id", "n_tokens", (F.col("known") + zero("more")).alias("n_known"),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("more_base")).alias("base_score"), (F.col("score") + zero("more_score")).alias("score"),
    )


def held_out(column="doc_id"):
    """One document in ten, by its id, takes no part in learning."""
    return id_bucket(F.col(column), 10) == 0


def train_and_score(documents: DataFrame) -> DataFrame:
    learning = documents.where(~held_out())
    counts = checkpointed(word_counts(learning))
    vocabulary = frequent_words(counts)
    model = train(learning, vocabulary)
    scored = score(documents, counts, vocabulary, model)
    return scored.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
