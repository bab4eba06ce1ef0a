"""Operator 5: quality classifier by positive-unlabelled learning.

Trusted positives are training-fold documents labelled good; everything unlabelled is a mixture of good
and bad in an unknown share. Where too little is unlabelled, all documents with labels ignored are that
mixture. The class prior is estimated from how a first classifier's scores are spread in both samples; then
a small network minimises the non-negative unbiased risk
    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)),
with the logistic loss, so that its output is a probability of being good. Bad labels are never used.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, held_out_fold, labelled_ids, sample_by_hash, small_batches, stored

#: Documents that the classifier is fitted on, at most: trusted positives, and unlabelled ones.
POSITIVES, UNLABELLED = 4000, 8000
THRESHOLD = 0.7
_PUNCTUATION = np.array([c for c in range(33, 127) if not chr(c).isalnum()])
_LETTERS = re.compile(r"[^\W\d_]+").findall
N_FEATURES = 19 + len(_PUNCTUATION)


def features(text: str) -> np.ndarray:
    """Rates that describe a whole text: lengths, case, punctuation, repetition, compressibility."""
    data = text.encode("utf-8", "replace")
    hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n, words, lines = max(1, len(data)), text.split(), text.split("\n")
    m = max(1, len(words))
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    same = sum(a == b for a, b in zip(words, words[1:]))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    letters = _LETTERS(text)
    upper = sum(map(str.isupper, letters))
    title = sum(map(str.istitle, letters))
    packed = sum(len(zlib.compress(data[i : i + (1 << 15)], 1)) for i in range(0, len(data), 1 << 15))
    return np.array(
        [
            np.log1p(len(text)), np.log1p(len(words)), np.log1p(len(lines)), lengths.mean(), lengths.std(), np.log1p(lengths.max()),
            len(counts) / m, max(counts.values(), default=0) / m, same / m, len(set(lines)) / len(lines), np.log1p(len(words) / len(lines)),
            upper / max(1, len(letters)), title / max(1, len(letters)), len(letters) / m, hist[48:58].sum() / n, hist[65:91].sum() / n,
            hist[128:].sum() / n, hist[_PUNCTUATION].sum() / n, packed / n,
            *np.log1p(1000 * hist[_PUNCTUATION] / n),
        ]
    )


def _featured(docs: DataFrame, text_col: str) -> DataFrame:
    """(y, x) for training rows of (y, text)."""

    def run(batches):
        for batch in batches:
            x = [features(t or "").tolist() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"])

    return docs.select("y", text_col).mapInArrow(run, "y int, x array<double>")


class Network:
    """Inputs standardised and clipped, one hidden layer, one output: the log-odds of being good."""

    def __init__(self, x: np.ndarray, hidden: int, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        self.p = [rng.normal(size=(x.shape[1], hidden)) / np.sqrt(x.shape[1]), np.zeros(hidden), rng.normal(size=hidden) / np.sqrt(hidden), np.zeros(1)]

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def out(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(z @ self.p[0] + self.p[1])
        return h, h @ self.p[2] + self.p[3][0]

    def fit(self, z: np.ndarray, slope, steps: int, rate: float = 0.01, decay: float = 1e-3) -> None:
        """Adam; ``slope(outputs)`` is the risk's derivative by each output."""
        m, v = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p]
        for t in range(1, steps + 1):
            h, f = self.out(z)
            d = slope(f)
            back = np.outer(d, self.p[2]) * (1 - h * h)
            grads = [z.T @ back + decay * self.p[0], back.sum(axis=0), h.T @ d + decay * self.p[2], np.array([d.sum()])]
            for p, g, a, b in zip(self.p, grads, m, v):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.out(self.scaled(x))[1])


def _sigmoid(f: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(f, -40, 40)))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among ``unlabelled``: the least ratio of both samples' upper score tails.

    Where scores are high hardly any negative is left, so the unlabelled tail is the prior times the
    positive tail. Half a deviation for the sample sizes is added against the bias of a minimum.
    """
    cuts = np.quantile(positive, np.linspace(0.0, 0.7, 50))
    p = np.array([(positive >= c).mean() for c in cuts])
    u = np.array([(unlabelled >= c).mean() for c in cuts])
    slack = 0.5 * np.sqrt(u * (1 - u) / len(unlabelled) + p * (1 - p) / len(positive))
    return float(np.clip(((u + slack) / p).min(), 0.02, 0.98))


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, hidden: int, seed: int, steps: int = 120) -> float:
    """``class_prior`` of scores that each half of the samples gets from a classifier fitted on the other."""
    halves = [(positive[i::2], unlabelled[i::2]) for i in range(2)]
    scores: list[list[np.ndarray]] = [[], []]
    for (p, u), others in zip(halves, halves[::-1]):
        x, n, m = np.concatenate([p, u]), max(1, len(p)), max(1, len(u))
        net = Network(x, hidden, seed)
        net.fit(net.scaled(x), lambda f, n=n, m=m: np.concatenate([(_sigmoid(f[:n]) - 1) / n, _sigmoid(f[n:]) / m]), steps)
        for k in range(2):
            scores[k].append(net.out(net.scaled(others[k]))[1])
    return class_prior(*(np.concatenate(s) for s in scores))


def risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative unbiased risk of outputs for both samples, and the direction by each output to step against.

    Where the estimate of the negatives' part is not below 0 that is the gradient; else it is that part's
    gradient turned round, which steps back from it.
    """
    p, u = len(positive), len(unlabelled)
    called_bad = lambda f: np.logaddexp(0, f).mean()
    negatives = called_bad(unlabelled) - prior * called_bad(positive)
    plus, minus = _sigmoid(positive), _sigmoid(unlabelled)
    rest = np.concatenate([-prior * plus / p, minus / u])
    value = prior * np.logaddexp(0, -positive).mean() + max(0.0, negatives)
    return value, np.concatenate([prior * (plus - 1) / p, np.zeros(u)]) + rest if negatives >= 0 else -rest


def fit(positive: np.ndarray, unlabelled: np.ndarray, hidden: int = 24, steps: int = 300, seed: int = 0) -> tuple[Network, float]:
    """The network of least non-negative risk, and the prior it assumed."""
    if min(len(positive), len(unlabelled)) < 2:
        positive, unlabelled = (np.repeat(a, 2, axis=0) for a in (positive, unlabelled))
    prior = estimated_prior(positive, unlabelled, hidden, seed)
    x = np.concatenate([positive, unlabelled])
    np_, nu = len(positive), len(unlabelled)
    net = Network(x, hidden, seed + 1)
    net.fit(net.scaled(x), lambda f: risk(f[:np_], f[np_:], prior)[1], steps)
    return net, prior


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> tuple[Network, float] | None:
    """Fit on ``docs`` by ``labels`` (doc_id, quality); None where there is nothing to fit on.

    Taken are at most ``positives`` documents labelled 1 in the training folds and at most ``unlabelled``
    documents that have no label and are of those folds too, whole texts each. Where those are fewer than
    the positives, the sample is drawn from all documents of those folds, labels ignored. An id counts once in
    either sample, by the least of its texts; null texts are empty.
    """
    good = stored(labelled_ids(labels.where("quality = 1"), "quality", positives, "doc_id"), "quality_good")
    ids = docs.select(F.col(id_col).alias("id")).where(F.col("id").isNotNull() & ~held_out_fold("id")).distinct()
    free = stored(sample_by_hash(ids.join(labels.select(F.col("doc_id").alias("id")), "id", "left_anti"), "id", unlabelled), "quality_free")
    if free.count() < min(good.count(), unlabelled):
        free = sample_by_hash(ids, "id", unlabelled)
    both = stored(good.select("id", F.lit(1).alias("y")).union(free.select("id", F.lit(0).alias("y"))), "quality_sample")
    # The sample has at most positives + unlabelled ids, so it may be broadcast; of rows that repeat an id one text is taken.
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(both), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    seen = _featured(rows, "text").collect() if not both.isEmpty() else []
    x, y = np.array([r.x for r in seen]).reshape(-1, N_FEATURES), np.array([r.y for r in seen])
    order = np.lexsort(x.T)  # the same model however the rows were dealt
    x, y = x[order], y[order]
    if not (y == 1).any() or not (y == 0).any():
        return None
    return fit(x[y == 1], x[y == 0])


def with_quality(docs: DataFrame, model: tuple[Network, float] | None, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with ``name``, the probability (0 to 1) that the whole text is good. Without a model: 0.5.

    A column of that name is replaced; null texts score as empty ones; empty in, empty out.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop(name)
    at, schema = docs.columns.index(text_col), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    net = model[0] if model else None

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            if net is None or not texts:
                scores = np.full(len(texts), 0.5)
            else:
                scores = net.score(np.array([features(t) for t in texts]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=schema.fieldNames())

    return docs.mapInArrow(run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted) for every row of ``docs``.

    Null texts score as empty ones. A null id counts as held out. Rows that repeat are scored each;
    language, source and id are no inputs; other columns are ignored. Empty in, empty out. Where no model
    can be fitted (no document is labelled good) scores are 0.5 and ``predicted`` is null.
    """
    small_batches(docs.sparkSession)
    model = train(docs, labels, id_col, text_col)
    scored = with_quality(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), model)
    predicted = (F.col("score") >= threshold).cast("int") if model else F.lit(None).cast("int")
    return scored.select(F.col("id").alias(id_col), held_out_fold("id").alias("held_out"), "score", predicted.alias("predicted"))


def good_only(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those whose score is under ``threshold``; all of them where no model can be fitted.

    Columns are as they were, whatever their names. Null texts are judged as empty ones, rows that repeat each
    alike; a null id matters to nothing here. Empty in, empty out.
    """
    model = train(docs, labels, id_col, text_col)
    if model is None:
        return docs
    mark = fresh(docs, "quality")
    return with_quality(docs, model, text_col, mark).where(F.col(mark) >= threshold).drop(mark)
