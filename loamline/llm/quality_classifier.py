"""A supervised subword classifier: averaged hashed vectors of words, word pairs and character n-grams, with a softmax.

The vectors and the output layer are learned by numpy stochastic gradient descent on a bounded sample. As the average
is linear, a trained model is folded into one number for each hashed feature, and texts are scored without vectors.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .subword import BASE, TRAIN_BYTES, TRAIN_ROWS, mix, ngram_hashes, training_sample, word_hashes, worker_table
from .tokens import bounded_batches

BUCKET_BITS, WIDTH, EPOCHS, MIN_STEPS, RATE = 17, 8, 4, 8000, 0.3
NGRAMS = (3, 4, 5)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _pairs(hashes: np.ndarray) -> np.ndarray:
    """Buckets of pairs of neighbours; all pairs of equal words are one feature."""
    with np.errstate(over="ignore"):
        both = mix(hashes[:-1] * BASE + hashes[1:])
    return _bucket(np.where(hashes[:-1] == hashes[1:], np.uint64(0), both))


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and their shares of all features of a text."""
    words = text.split()
    if not words:
        return np.empty(0, np.int64), np.empty(0)
    distinct, inverse, counts = np.unique(np.array(words, object), return_inverse=True, return_counts=True)
    hashes = word_hashes(list(distinct))
    grams, of = ngram_hashes(list(distinct), NGRAMS)
    total = np.bincount(_bucket(hashes), counts, 1 << BUCKET_BITS) + np.bincount(_bucket(grams), counts[of], 1 << BUCKET_BITS)
    if len(words) > 1:
        total += np.bincount(_pairs(hashes[inverse]), minlength=1 << BUCKET_BITS)
    at = np.flatnonzero(total)
    return at, total[at] / total.sum()


@dataclass
class QualityModel:
    """A trained model, folded: the logit of label 1 is the mean of weights over a text's features, plus bias."""

    weights: np.ndarray
    bias: float
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def compute(self, words: list[bytes]) -> list[np.ndarray]:
        hashes = word_hashes(words)
        grams, of = ngram_hashes(words, NGRAMS)
        n = len(words)
        total = self.weights[_bucket(hashes)] + np.bincount(of, self.weights[_bucket(grams)], n)
        return [total, 1.0 + np.bincount(of, minlength=n), hashes]

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        table = worker_table(self.name, self.compute)
        out = np.empty(len(texts))
        for i, text in enumerate(texts):
            logit = self.bias
            if words := (text or b"").split():
                rows = table.rows(words)
                sums, counts, hashes = (c[rows] for c in table.columns)
                total, n = sums.sum(), counts.sum()
                if len(words) > 1:
                    pairs = self.weights[_pairs(hashes)]
                    total, n = total + pairs.sum(), n + len(pairs)
                logit += total / n
            out[i] = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
        return out


def train(sample: list[tuple[bytes, int]], seed: int = 0, epochs: int = EPOCHS, rate: float = RATE) -> QualityModel:
    """A model of label 1 against label 0. A sample of one label, or an empty one, gives a constant score."""
    y = np.array([int(label) for _, label in sample])
    share = (y.sum() + 0.5) / (len(y) + 1)
    flat = QualityModel(np.zeros(1 << BUCKET_BITS), float(np.log(share / (1 - share))))
    if not 0 < y.sum() < len(y):
        return flat
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (1 << BUCKET_BITS, WIDTH))
    seen = np.full(1 << BUCKET_BITS, 1e-8)  # squared gradients: rare features move as far as frequent ones
    out, bias = np.zeros((WIDTH, 2)), np.zeros(2)
    rows = [features(text) for text, _ in sample]
    epochs = max(epochs, -(-MIN_STEPS // len(rows)))  # small samples are seen more often
    steps, step = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, value = rows[i]
            pace = rate * (1 - step / steps)
            step += 1
            hidden = value @ vectors[at]
            logits = hidden @ out + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = out @ p
            out -= pace * np.outer(hidden, p)
            bias -= pace * 0.1 * p
            if len(at) and (size := back @ back) > 0:
                seen[at] += value**2 * size
                vectors[at] -= pace * (value / np.sqrt(seen[at]))[:, None] * back
    return QualityModel(vectors @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0]))


def fit(texts: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, max_bytes: int = TRAIN_BYTES, seed: int = 0) -> QualityModel:
    """texts: columns id and text; labels: id and label (0 or 1). rows bounds the sample of each label, max_bytes a text of it."""
    return train(training_sample(texts, labels, rows, max_bytes), seed)


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1) of each row's whole text. Null and empty texts get the score of a text of no features.

    Rows are scored one by one: repeated rows get equal scores, an empty table none. Other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**BUCKET_BITS numbers, whatever the data

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sent.value.scores(b.column(1).to_pylist()))], [id_col, "score"])

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("binary").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, score double")
