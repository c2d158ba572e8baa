"""Toxicity by multiple-instance learning: a document is toxic if one of its sentences is.

Each sentence has a probability from hashed words and character n-grams; noisy-or joins those of a document, and the
gradient of the document's likelihood trains the sentence model, with no labels of sentences. The sentences above the
threshold are then the places of the offence.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .subword import TRAIN_BYTES, TRAIN_ROWS, ngram_hashes, training_sample, word_hashes, worker_table
from .tokens import bounded_batches

BUCKET_BITS, NGRAMS, EPOCHS, MIN_STEPS, RATE, START = 18, (3, 4, 5, 6), 5, 8000, 0.25, -7.0
#: Words of a sentence at least; without this, shouting ("NO!! NO!!") is thousands of sentences.
MIN_WORDS = 6
LEAK = 0.05
STRIP = b".,;:!?\"'()[]{}<>*-_"
_TOKEN = re.compile(rb"[^\x20\x09-\x0D]+")


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _bare(words: list[bytes]) -> list[bytes]:
    return [w.strip(STRIP).lower() for w in words]


def _ends(words: list[bytes]) -> np.ndarray:
    """Whether a sentence ends with the word."""
    return np.array([w[-1:] in (b".", b"!", b"?") for w in words], bool)


def _tokens(text: bytes) -> tuple[list[bytes], np.ndarray]:
    """A text's words, and the places of the last word of each line."""
    words, breaks = [], []
    for line in text.split(b"\n"):
        if found := line.split():
            words += found
            breaks.append(len(words) - 1)
    return words, np.array(breaks, np.int64)


def _sentences(ends: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """The index of each word's sentence. A sentence of under MIN_WORDS words goes on into the next one."""
    last = ends.copy()
    last[breaks] = True
    begin = 0
    for at in np.flatnonzero(last):
        if at + 1 - begin < MIN_WORDS:
            last[at] = False
        else:
            begin = at + 1
    return np.concatenate([[0], np.cumsum(last)[:-1]]).astype(np.int64)


def _evidence(words: np.ndarray) -> np.ndarray:
    """What each word adds to its sentence: harmless words hardly outweigh an offending one, however many they are."""
    return np.where(words > 0, words, LEAK * words)


@dataclass
class ToxicityModel:
    weights: np.ndarray
    bias: float
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def compute(self, words: list[bytes]) -> list[np.ndarray]:
        bare = _bare(words)
        grams, of = ngram_hashes(bare, NGRAMS)
        return [self.weights[_bucket(word_hashes(bare))] + np.bincount(of, self.weights[_bucket(grams)], len(words)), _ends(words)]

    def sentences(self, text: bytes) -> np.ndarray:
        """The probability of each sentence of a text that has a word."""
        words, breaks = _tokens(text)
        if not words:
            return np.empty(0)
        table = worker_table(self.name, self.compute)
        rows = table.rows(words)
        of = _sentences(table.columns[1][rows], breaks)
        return 1 / (1 + np.exp(-np.clip(np.bincount(of, _evidence(table.columns[0][rows])) + self.bias, -60, 60)))

    def score(self, each: np.ndarray) -> float:
        return float(-np.expm1(np.log1p(-np.minimum(each, 1 - 1e-12)).sum()))


def locate(text: bytes, wanted: np.ndarray) -> list[tuple[int, int]]:
    """Start and length in bytes of the sentences of these indexes."""
    if not len(wanted):
        return []
    words, breaks = _tokens(text)
    of = _sentences(_ends(words), breaks)
    spans = [m.span() for m in _TOKEN.finditer(text)]
    first, last = np.searchsorted(of, wanted, "left"), np.searchsorted(of, wanted, "right") - 1
    return [(spans[a][0], spans[b][1] - spans[a][0]) for a, b in zip(first, last, strict=True)]


def _word_features(words: list[bytes], at_once: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the words' features, one word's after another's, and where each word's begin (and the last's end).

    A sample has few distinct words, so this takes a fraction of the memory that features of every word in place would.
    """
    buckets, sizes = [np.empty(0, np.int32)], [np.zeros(1, np.int64)]
    for i in range(0, len(words), at_once):
        some = words[i : i + at_once]
        grams, of = ngram_hashes(some, NGRAMS)
        of = np.concatenate([np.arange(len(some)), of])
        buckets.append(np.concatenate([_bucket(word_hashes(some)), _bucket(grams)])[np.argsort(of, kind="stable")].astype(np.int32))
        sizes.append(np.bincount(of, minlength=len(some)))
    return np.concatenate(buckets), np.cumsum(np.concatenate(sizes))


def train(sample: list[tuple[bytes, int]], seed: int = 0, epochs: int = EPOCHS, rate: float = RATE, start: float = START) -> ToxicityModel:
    """Learns from texts and document labels. start: the bias before training. Without both labels the model scores every sentence alike, near 0."""
    rng = np.random.default_rng(seed)
    weights, seen = np.zeros(1 << BUCKET_BITS), np.full(1 << BUCKET_BITS, 1e-2)
    bias, bias_seen = start, 1e-2
    index: dict[bytes, int] = {}
    bags = []
    for text, label in sample:
        words, breaks = _tokens(text)
        if words:
            rows = np.array([index.setdefault(w, len(index)) for w in _bare(words)], np.int32)
            bags.append((rows, _sentences(_ends(words), breaks).astype(np.int32), int(label)))
    if len({label for *_, label in bags}) < 2:
        return ToxicityModel(weights, start)
    buckets, first = _word_features(list(index))
    epochs = max(epochs, -(-MIN_STEPS // len(bags)))  # small samples are seen more often
    for epoch in range(epochs):
        pace = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(bags)):
            rows, of, label = bags[i]
            distinct, place = np.unique(rows, return_inverse=True)
            sizes = first[distinct + 1] - first[distinct]
            word = np.repeat(np.arange(len(distinct)), sizes)
            at = buckets[np.arange(len(word)) + np.repeat(first[distinct] - (np.cumsum(sizes) - sizes), sizes)]
            each = np.bincount(word, weights[at])
            p = 1 / (1 + np.exp(-np.clip(np.bincount(of, _evidence(each)[place]) + bias, -60, 60)))
            p = np.minimum(p, 1 - 1e-12)
            none = np.exp(np.log1p(-p).sum())  # that no sentence is toxic
            g = -p * none / max(1 - none, 1e-9) if label else p
            if np.abs(g).max() < 1e-4:
                continue
            pull = (np.bincount(place, g[of]) * np.where(each >= 0, 1, LEAK))[word]
            live = np.abs(pull) > 1e-6
            hit, back = np.unique(at[live], return_inverse=True)
            slope = np.bincount(back, pull[live])
            seen[hit] += slope**2
            weights[hit] -= pace * slope / np.sqrt(seen[hit])
            bias_seen += g.sum() ** 2
            bias -= 0.3 * pace * g.sum() / np.sqrt(bias_seen)
    return ToxicityModel(weights, bias)


def fit(texts: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, max_bytes: int = TRAIN_BYTES, seed: int = 0) -> ToxicityModel:
    """texts: columns id and text; labels: id and label (0 or 1). rows bounds the sample of each label, max_bytes a text of it."""
    return train(training_sample(texts, labels, rows, max_bytes), seed)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """id, score (0 to 1) and sentences: start, length (bytes) and score of each sentence at or above threshold.

    Sentences end with a word that ends in . ! or ?, and with a line. Null and empty texts have no sentence and score
    0. Repeated rows get equal results, an empty table none. Other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**BUCKET_BITS numbers, whatever the data
    place = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        m = sent.value
        for b in batches:
            scores, places = [], []
            for text in b.column(1).to_pylist():
                each = m.sentences(text or b"")
                wanted = np.flatnonzero(each >= threshold)
                scores.append(m.score(each))
                places.append([{"start": s, "length": n, "score": float(p)} for (s, n), p in zip(locate(text or b"", wanted), each[wanted], strict=True)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(places, place)], [id_col, "score", "sentences"])

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("binary").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, score double, sentences array<struct<start:long,length:long,score:double>>")
