"""Language identification by a linear-chain conditional random field over the words of a text.

A word's features are its hash, its affixes and n-grams, and its entries in per-language lexicons of the training
words; labels of neighbouring words are tied by learned transitions, so a code-switched text changes language where
its words do. Forward-backward gives every word's marginal probabilities; a text's language is the one with the
largest mean. Chains are runs of at most CHAIN words, whole texts are covered by as many chains as they need, and all
chains of a batch step forward together.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .subword import TRAIN_BYTES, TRAIN_ROWS, ngram_hashes, training_sample, word_hashes, worker_table
from .tokens import bounded_batches

BUCKET_BITS, NGRAMS, CHAIN, RATE, BATCH_CHAINS, MAX_BATCHES = 16, (2, 3, 4, 5), 128, 0.3, 64, 160
#: Texts of each language in the sample, words of a language's lexicon, and the share a lexicon word has in it.
LANGUAGE_ROWS, LEXICON, LEXICON_SHARE = 400, 300, 0.7
UNDETERMINED = "und"
#: Runs of word characters but digits and _; these hold letters, and numbers such as fractions and superscripts.
RUNS = re.compile(r"[^\W\d_]+")
#: A stretch of words of one language: the number of its first word, how many words, and the language.
SPAN = "struct<first_word:long,n_words:long,lang:string>"


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def words_of(text: str | None) -> list[str]:
    """The maximal runs of letters (Unicode's categories L*) of a text, lower-cased."""
    found = RUNS.findall(text.lower()) if text else []
    if all(map(str.isalpha, found)):
        return found
    return [w for run in found for w in "".join(c if c.isalpha() else " " for c in run).split()]


def forward_backward(emissions: np.ndarray, transitions: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (chain, place, label) and expected transition counts, all chains at once.

    emissions: log potentials (chain, place, label), of which only the first lengths count in each chain.
    """
    n, t, _ = emissions.shape
    e = np.exp(emissions - emissions.max(axis=2, keepdims=True))
    m = np.exp(transitions - transitions.max())
    ahead = np.empty_like(e)
    ahead[:, 0] = e[:, 0] * np.exp(start - start.max())
    ahead[:, 0] /= ahead[:, 0].sum(axis=1, keepdims=True)
    for i in range(1, t):
        step = (ahead[:, i - 1] @ m) * e[:, i]
        ahead[:, i] = step / step.sum(axis=1, keepdims=True)
    behind = np.ones_like(e)
    counts = np.zeros_like(m)
    for i in range(t - 2, -1, -1):
        back = (e[:, i + 1] * behind[:, i + 1]) @ m.T
        back /= back.sum(axis=1, keepdims=True)
        inside = (lengths > i + 1)[:, None]
        behind[:, i] = np.where(inside, back, 1)
        pair = ahead[:, i, :, None] * m[None] * (e[:, i + 1] * behind[:, i + 1])[:, None, :]
        counts += (pair / pair.sum(axis=(1, 2), keepdims=True) * inside[:, :, None]).sum(axis=0)
    marginals = ahead * behind
    return marginals / marginals.sum(axis=2, keepdims=True), counts


def marginals_only(emissions: np.ndarray, transitions: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The marginals of forward_backward() without transition counts; places come first: (place, chain, label)."""
    e = np.exp(emissions - emissions.max(axis=2, keepdims=True))
    t = len(e)
    m = np.exp(transitions - transitions.max()).astype(e.dtype)
    back_m = np.ascontiguousarray(m.T)
    ahead = np.empty_like(e)
    ahead[0] = e[0] * np.exp(start - start.max()).astype(e.dtype)
    for i in range(1, t):
        np.multiply(ahead[i - 1] @ m, e[i], out=ahead[i])
        ahead[i] /= ahead[i].max(axis=1, keepdims=True)
    behind = np.ones_like(e[0])
    for i in range(t - 2, -1, -1):
        back = (e[i + 1] * behind) @ back_m
        back /= back.max(axis=1, keepdims=True)
        behind = np.where((lengths > i + 1)[:, None], back, 1)
        ahead[i] *= behind
    return ahead / ahead.sum(axis=2, keepdims=True)


@dataclass
class LanguageModel:
    labels: list[str]
    weights: np.ndarray
    lexicons: dict[str, int]
    lexicon_weights: np.ndarray
    transitions: np.ndarray
    start: np.ndarray
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets, the word of each, and every word's lexicon (the last row of lexicon_weights: none)."""
        raw = [w.encode("utf-8", "replace") for w in words]
        grams, of = ngram_hashes(raw, NGRAMS)
        none = len(self.labels)
        return np.concatenate([_bucket(word_hashes(raw)), _bucket(grams)]), np.concatenate([np.arange(len(raw)), of]), np.array([self.lexicons.get(w, none) for w in words], np.int64)

    def compute(self, words: list[str]) -> list[np.ndarray]:
        at, of, lexicon = self.features(words)
        n = np.bincount(of, minlength=len(words))[:, None]
        total = np.stack([np.bincount(of, self.weights[at, k], len(words)) for k in range(len(self.labels))], axis=1)
        return [(total / np.sqrt(n) + self.lexicon_weights[lexicon]).astype(np.float32)]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[list[tuple[int, int, str]]]]:
        """The language of each text, its mean marginal, and the spans of words by their own languages.

        und, 0 and no span for a text of no letters.
        """
        found = [words_of(t) for t in texts]
        sizes = np.array([len(w) for w in found], np.int64)
        names, scores, spans = [UNDETERMINED] * len(texts), [0.0] * len(texts), [[] for _ in texts]
        if not self.labels or not sizes.sum():
            return names, scores, spans
        table = worker_table(self.name, self.compute)
        rows = table.rows([w for ws in found for w in ws])
        each = table.columns[0]
        chains = -(-sizes // CHAIN)
        doc = np.repeat(np.arange(len(texts)), chains)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(chains) - chains, chains)
        begin = np.repeat(np.cumsum(sizes) - sizes, chains) + nth * CHAIN
        lengths = np.minimum(CHAIN, np.repeat(sizes, chains) - nth * CHAIN)
        sums = np.zeros((len(texts), len(self.labels)))
        best = np.empty(sizes.sum(), np.int32)
        for a in range(0, len(doc), 1024):  # bounds the memory of a batch of very long texts
            b = slice(a, a + 1024)
            place = np.arange(int(lengths[b].max()))
            inside = place[:, None] < lengths[b][None, :]
            grid = each[rows[np.where(inside, begin[b][None, :] + place[:, None], 0)]]
            p = marginals_only(grid, self.transitions, self.start, lengths[b]) * inside[:, :, None]
            np.add.at(sums, doc[b], p.sum(axis=0))
            best[(begin[b][None, :] + place[:, None])[inside]] = p.argmax(axis=2)[inside]
        starts = np.cumsum(sizes) - sizes
        turns = np.flatnonzero(np.diff(best)) + 1
        edges = np.union1d(turns, starts[sizes > 0])  # where a span begins
        lengths = np.diff(np.append(edges, len(best)))
        owner = np.searchsorted(starts, edges, "right") - 1
        for at, n, i in zip(edges.tolist(), lengths.tolist(), owner.tolist(), strict=True):
            spans[i].append((at - int(starts[i]), n, self.labels[best[at]]))
        for i in np.flatnonzero(sizes):
            k = int(sums[i].argmax())
            names[i], scores[i] = self.labels[k], float(min(1.0, sums[i, k] / sizes[i]))
        return names, scores, spans


def train(sample: list[tuple[bytes, str]], seed: int = 0, max_batches: int = MAX_BATCHES) -> LanguageModel:
    """Learns from texts with one language each. Training chains join stretches of several texts, as switching does."""
    labels = sorted({label for _, label in sample})
    k = len(labels)
    rng = np.random.default_rng(seed)
    texts = [(words_of(text.decode("utf-8", "replace")), labels.index(label)) for text, label in sample]
    texts = [(w, y) for w, y in texts if w]
    uses = [Counter() for _ in labels]
    for w, y in texts:
        uses[y].update(set(w))
    docs = np.array([max(1, sum(y == j for _, y in texts)) for j in range(k)])
    lexicons = {}
    for j in range(k):
        for w, n in uses[j].most_common(LEXICON):
            rates = [uses[i][w] / docs[i] for i in range(k)]
            if n > 1 and rates[j] >= LEXICON_SHARE * sum(rates):
                lexicons[w] = j
    model = LanguageModel(labels, np.zeros((1 << BUCKET_BITS, k)), lexicons, np.zeros((k + 1, k)), np.zeros((k, k)), np.zeros(k))
    if k < 2 or not texts:
        return model
    seen, lexicon_seen = np.full(1 << BUCKET_BITS, 1e-3), np.full(k + 1, 1e-3)
    by_label = [[w for w, y in texts if y == j] for j in range(k)]
    kept = [j for j in range(k) if by_label[j]]
    length, seen_m = 48, np.full((k, k), 1.0)
    for batch in range(max_batches):
        pace = RATE * (1 - batch / max_batches)
        words, gold, lengths = [], np.zeros((BATCH_CHAINS, length), np.int64), np.full(BATCH_CHAINS, length)
        for c in range(BATCH_CHAINS):
            chain, marks = [], []
            while len(chain) < length:
                j = kept[rng.integers(len(kept))]
                w = by_label[j][rng.integers(len(by_label[j]))]
                size = int(rng.integers(8, 49))
                begin = int(rng.integers(max(1, len(w) - size + 1)))
                chain += w[begin : begin + size]
                marks += [j] * len(w[begin : begin + size])
            words += chain[:length]
            gold[c] = marks[:length]
        distinct, inverse = np.unique(np.array(words, object), return_inverse=True)
        at, of, lexicon = model.features(list(distinct))
        n = np.sqrt(np.bincount(of, minlength=len(distinct)))
        total = np.stack([np.bincount(of, model.weights[at, j], len(distinct)) for j in range(k)], axis=1)
        emissions = (total / n[:, None] + model.lexicon_weights[lexicon])[inverse].reshape(BATCH_CHAINS, length, k)
        p, counts = forward_backward(emissions, model.transitions, model.start, lengths)
        truth = np.eye(k)[gold]
        slope = (p - truth).reshape(-1, k)
        per_word = np.stack([np.bincount(inverse, slope[:, j], len(distinct)) for j in range(k)], axis=1)
        hit, back = np.unique(at, return_inverse=True)
        change = np.stack([np.bincount(back, per_word[of, j] / n[of], len(hit)) for j in range(k)], axis=1)
        seen[hit] += (change**2).sum(axis=1)
        model.weights[hit] -= pace * change / np.sqrt(seen[hit])[:, None]
        by_lexicon = np.stack([np.bincount(lexicon, per_word[:, j], k + 1) for j in range(k)], axis=1)
        lexicon_seen += (by_lexicon**2).sum(axis=1)
        model.lexicon_weights -= pace * by_lexicon / np.sqrt(lexicon_seen)[:, None]
        actual = np.zeros((k, k))
        np.add.at(actual, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
        step = counts - actual
        seen_m += step**2
        model.transitions -= pace * step / np.sqrt(seen_m)
        model.start -= pace * 0.1 * (p[:, 0] - truth[:, 0]).mean(axis=0)
    return model


def fit(texts: DataFrame, labels: DataFrame, rows: int = LANGUAGE_ROWS, max_bytes: int = TRAIN_BYTES, seed: int = 0) -> LanguageModel:
    """texts: columns id and text; labels: id and label (a language; null rows teach nothing). rows bounds each language's sample, max_bytes a text of it."""
    return train(training_sample(texts, labels, min(rows, TRAIN_ROWS), max_bytes), seed)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score", spans_col: str = "spans") -> DataFrame:
    """docs with the language of each whole text, its score (0 to 1), and the spans (SPAN) of the languages of its words.

    A word is a maximal run of letters. A null text, or one with no letter, is und with score 0 and no span; so is every
    text if nothing could be learned. Ties go to the language first in the alphabet. Repeated rows get equal results, an
    empty table none. Other columns pass through; columns of the three new names, whatever their case, are replaced.
    """
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**BUCKET_BITS rows of a number a language
    made = [lang_col, score_col, spans_col]
    docs = docs.drop(*[c for c in docs.columns if c.lower() in {m.lower() for m in made} and c != text_col])
    at = docs.columns.index(text_col)
    span = pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64()), ("lang", pa.string())]))

    def run(batches):
        for b in batches:
            names, scores, spans = sent.value.predict(b.column(at).to_pylist())
            listed = [[{"first_word": f, "n_words": n, "lang": k} for f, n, k in s] for s in spans]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(listed, span)], [*b.schema.names, *made])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, `{lang_col}` string, `{score_col}` double, `{spans_col}` array<{SPAN}>")
