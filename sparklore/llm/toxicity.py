"""Operator 6: toxicity by multiple-instance learning.

A document is a bag of sentences and only the bag is labelled. A sentence's probability is logistic in the
words and word beginnings it holds; a document's is the noisy-or of its sentences', 1 - prod(1 - p). The
weights maximise the likelihood of document labels (part of which may be wrong), and the fitted sentence
probabilities then say which sentences offend.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, held_out_fold, labelled_ids, small_batches, stored

#: Labelled documents that the model is fitted on, and features it can have, at most.
FITTED, FEATURES = 8000, 4000
#: Log-odds that a sentence's evidence is added to (one without any has probability 0); share of document labels taken to be wrong.
CLEAN, WRONG = -11.0, 0.02
THRESHOLD = 0.3
#: A feature is in at least so many fitted documents.
LEAST_DOCUMENTS = 4
#: Words that a worker remembers the weight of; at the bound it starts anew.
REMEMBERED = 200_000
BEGINNINGS = range(3, 9)
_SENTENCE = re.compile(r"[^.!?\n]+").finditer
_WORDS = re.compile(r"[^\W\d_]+").findall


def word_features(word: str) -> list[str]:
    """The word itself, and its beginnings, each marked by what it is."""
    return ["=" + word, *("^" + word[:n] for n in BEGINNINGS if n <= len(word))]


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, lower-case words) of each stretch between full stops, marks and line ends that has words."""
    found = ((m.start(), m.end(), _WORDS(m.group().lower())) for m in _SENTENCE(text))
    return [s for s in found if s[2]]


class Model:
    def __init__(self, weights: dict[str, float]):
        self.weights, self.known = weights, {}

    def __getstate__(self):
        return {"weights": self.weights, "known": {}}

    def word(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in word_features(word))

    def judged(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's probability, and (start, end, probability) of the sentences with any evidence."""
        known, total, out = self.known, 0.0, []
        if len(known) > REMEMBERED:
            known.clear()
        for start, end, words in sentences(text):
            z = 0.0
            for w in words:
                v = known.get(w)
                if v is None:
                    v = known[w] = self.word(w)
                z += v
            if z:
                p = 1 / (1 + np.exp(-min(40.0, max(-40.0, CLEAN + z))))
                total -= np.log1p(-min(p, 1 - 1e-12))
                out.append((start, end, float(p)))
        return float(-np.expm1(-total)), out


def fit(documents: list[tuple[int, list[list[int]]]], n_features: int, steps: int = 300) -> np.ndarray:
    """Weights by Adam on the noisy-or likelihood. ``documents``: (label, features of each sentence that has any)."""
    bags = Bags(documents, n_features)
    w, m, v = (np.zeros(n_features) for _ in range(3))
    for t in range(1, steps + 1):
        g = bags.loss(w)[1]
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


class Bags:
    """Labelled documents as bags of sentences, each the features it has."""

    def __init__(self, documents: list[tuple[int, list[list[int]]]], n_features: int):
        self.n_features, self.y = n_features, np.array([d[0] for d in documents], dtype=float)
        self.owner = np.array([i for i, d in enumerate(documents) for _ in d[1]], dtype=np.int64)
        bags = [s for d in documents for s in d[1]]
        self.size, self.row = len(bags), np.repeat(np.arange(len(bags)), [len(s) for s in bags]) if bags else np.zeros(0, np.int64)
        self.col = np.array([f for s in bags for f in s], dtype=np.int64)

    def loss(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        """Minus the log-likelihood of the labels under the noisy-or, a penalty on the weights added, and its gradient."""
        y, owner = self.y, self.owner
        z = np.clip(CLEAN + np.bincount(self.row, w[self.col], self.size), -30, 30)
        amount = np.bincount(owner, np.logaddexp(0, z), len(y)) + 1e-12  # -log of the clean probability
        noisy = WRONG + (1 - 2 * WRONG) * -np.expm1(-amount)
        value = -(y * np.log(noisy) + (1 - y) * np.log1p(-noisy)).sum() + 0.005 * (w * w).sum()
        slope = (noisy - y) / (noisy * (1 - noisy)) * (1 - 2 * WRONG) * np.exp(-amount)
        return value, np.bincount(self.col, (slope[owner] / (1 + np.exp(-z)))[self.row], self.n_features) + 0.01 * w


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = FITTED, features: int = FEATURES) -> Model:
    """Fit on at most ``most`` labelled documents (whole texts) of the training folds by ``labels`` (doc_id, toxic).

    Features are words and word beginnings that lean to toxic documents the most. Without labels of both
    kinds nothing is toxic. An id counts once, by the least of its texts; null texts are empty.
    """
    ids = stored(labelled_ids(labels, "toxic", most), "toxicity_sample")
    # The sample has at most ``most`` ids, so it may be broadcast; of rows that repeat an id one text is taken.
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    sample = stored(texts.select("id", "text", "y"), "toxicity_texts")
    n1, n0 = (sample.where(F.col("y") == k).count() for k in (1, 0))
    if not n1 or not n0:
        return Model({})

    def spread(batches):
        for batch in batches:
            seen = [(f, y) for t, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()) for f in {f for _, _, ws in sentences(t or "") for w in set(ws) for f in word_features(w)}]
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in seen], pa.string()), pa.array([y for _, y in seen], pa.int32())], names=["f", "y"])

    counts = sample.select("id", "text", F.col("y").cast("int")).mapInArrow(spread, "f string, y int").groupBy("f").agg(F.sum("y").alias("a"), F.count("*").alias("n"))
    share = n1 / (n1 + n0)
    lean = (F.col("a") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    chosen = [r.f for r in counts.where(F.col("n") >= LEAST_DOCUMENTS).withColumn("lean", lean).where("lean > 3").orderBy(F.desc("lean"), "f").limit(features).collect()]
    index = {f: i for i, f in enumerate(chosen)}

    def bags(batches):
        for batch in batches:
            held = []
            for t in batch.column(1).to_pylist():
                rows = [sorted({index[f] for w in ws for f in word_features(w) if f in index}) for _, _, ws in sentences(t or "")]
                held.append([r for r in rows if r])
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(held, pa.list_(pa.list_(pa.int32())))], names=["y", "bags"])

    rows = sample.select("id", "text", F.col("y").cast("int")).mapInArrow(bags, "y int, bags array<array<int>>").collect()
    weights = fit([(r.y, r.bags) for r in rows], len(chosen))
    return Model({f: float(weights[i]) for f, i in index.items() if abs(weights[i]) > 1e-3})


def with_toxicity(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score", located: str | None = None, sure: float = 0.5) -> DataFrame:
    """``docs`` with ``name``, the probability that the whole text is toxic.

    ``located`` names a further column: start, end (characters, end excluded) and probability of the
    sentences with a probability of at least ``sure``. Columns of those names are replaced. Null texts are
    empty and score 0; empty in, empty out.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop(name, *([located] if located else []))
    at, fields = docs.columns.index(text_col), [*docs.schema.fields, T.StructField(name, T.DoubleType())]
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
    if located:
        fields.append(T.StructField(located, T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))))
    schema = T.StructType(fields)

    def run(batches):
        for batch in batches:
            found = [model.judged(t or "") for t in batch.column(at).to_pylist()]
            columns = [*batch.columns, pa.array([s for s, _ in found], pa.float64())]
            if located:
                columns.append(pa.array([[dict(zip(("start", "end", "score"), x)) for x in spans_ if x[2] >= sure] for _, spans_ in found], spans))
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return docs.mapInArrow(run, schema)


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted, offending) for every row of ``docs``.

    Null and wordless texts score 0. A null id counts as held out. Rows that repeat are scored each;
    language, source and id are no inputs; other columns are ignored. Empty in, empty out.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    scored = with_toxicity(rows, train(docs, labels, id_col, text_col), located="offending")
    return scored.select(F.col("id").alias(id_col), held_out_fold("id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "offending")


def clean_only(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those whose score is ``threshold`` or more.

    Columns are as they were, whatever their names. Null and wordless texts stay, rows that repeat are judged
    each alike; a null id matters to nothing here. Empty in, empty out.
    """
    mark = fresh(docs, "toxicity")
    return with_toxicity(docs, train(docs, labels, id_col, text_col), text_col, mark).where(F.col(mark) < threshold).drop(mark)
