"""The learned models' scores of every row against plain versions, a feature at a time, from the same weights."""

import math
import os
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loamline.llm import language_id, quality_classifier, toxicity
from loamline.llm.subword import BASE

DATA = "/root/testdata/sf0.001"
ALL = (1 << 64) - 1


def mixed(x):
    for _ in range(2):
        x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 & ALL
    return x ^ x >> 32


def marked(word):
    return [b + 1 for b in b"<" + word + b">"]


def word_hash(word):
    total, power = 0, 1
    for b in marked(word):
        power = power * int(BASE) & ALL
        total += mixed(b + power & ALL) * power
    return mixed(total & ALL)


def gram_hashes(word, sizes):
    data = marked(word)
    for n in sizes:
        for i in range(len(data) - n + 1):
            h = n
            for b in data[i : i + n]:
                h = h * int(BASE) + b & ALL
            yield mixed(h)


@pytest.fixture(scope="module")
def texts():
    given = [(-1, None), (-2, ""), (-3, " \n\t"), (-4, "x"), (-5, "NO!! NO!! " * 40), (-6, "é " * 300), (-7, "one. two\nthree! " * 30), (-8, "12 ½ ²")]
    if os.path.isdir(DATA):
        given += duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall()
    return given


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(texts, "doc_id long, text string").repartition(3)


def plain_quality(model, text):
    words, found = (text or "").encode().split(), []
    bucket = lambda h: h >> 64 - quality_classifier.BUCKET_BITS
    for w in words:
        found += [bucket(word_hash(w)), *(bucket(h) for h in gram_hashes(w, quality_classifier.NGRAMS))]
    for a, b in zip(words, words[1:], strict=False):
        x, y = word_hash(a), word_hash(b)
        found.append(bucket(0 if x == y else mixed(x * int(BASE) + y & ALL)))
    return 1 / (1 + math.exp(-(model.bias + (sum(model.weights[f] for f in found) / len(found) if found else 0))))


def test_quality_scores_equal_plain_ones(docs, texts):
    model = quality_classifier.QualityModel(np.random.default_rng(1).normal(size=1 << quality_classifier.BUCKET_BITS) * 20, 0.3)
    got = {r["doc_id"]: r["score"] for r in quality_classifier.score(docs, model).collect()}
    short = [(i, t) for i, t in texts if len(t or "") < 20_000]
    assert len(short) > 0.9 * len(texts) and set(got) == {i for i, _ in texts}
    assert [i for i, t in short if abs(got[i] - plain_quality(model, t)) > 1e-9] == []


def plain_toxicity(model, text):
    sentences, open_ = [], []
    for line in (text or "").encode().split(b"\n"):
        words = line.split()
        for k, w in enumerate(words):
            open_.append(w)
            if (w[-1:] in (b".", b"!", b"?") or k == len(words) - 1) and len(open_) >= toxicity.MIN_WORDS:
                sentences.append(open_)
                open_ = []
    sentences += [open_] if open_ else []
    bucket = lambda h: h >> 64 - toxicity.BUCKET_BITS
    none = 1.0
    for s in sentences:
        logit = model.bias
        for w in s:
            bare = w.strip(toxicity.STRIP).lower()
            value = model.weights[bucket(word_hash(bare))] + sum(model.weights[bucket(h)] for h in gram_hashes(bare, toxicity.NGRAMS))
            logit += value if value > 0 else toxicity.LEAK * value
        none *= 1 - min(1 / (1 + math.exp(-max(-60, min(60, logit)))), 1 - 1e-12)
    return 1 - none


def test_toxicity_scores_equal_plain_ones(docs, texts):
    model = toxicity.ToxicityModel(np.random.default_rng(2).normal(size=1 << toxicity.BUCKET_BITS) * 0.05, -6.0)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    short = [(i, t) for i, t in texts if len(t or "") < 20_000]
    assert [i for i, t in short if abs(got[i] - plain_toxicity(model, t)) > 1e-9] == []
    assert 0.05 < np.mean([s > 0.5 for s in got.values()]) < 0.95


def plain_language(model, text):
    words = ["".join(run) for run in re.findall(r"[^\W\d_]+", (text or "").lower())]
    words = [w for run in words for w in "".join(c if c.isalpha() else " " for c in run).split()]
    k, sums = len(model.labels), np.zeros(len(model.labels))
    bucket = lambda h: h >> 64 - language_id.BUCKET_BITS
    potential = {}
    for w in set(words):
        raw = w.encode()
        found = [bucket(word_hash(raw)), *(bucket(h) for h in gram_hashes(raw, language_id.NGRAMS))]
        potential[w] = sum(model.weights[f] for f in found) / math.sqrt(len(found)) + model.lexicon_weights[model.lexicons.get(w, k)]
    for at in range(0, len(words), language_id.CHAIN):
        e = [potential[w] for w in words[at : at + language_id.CHAIN]]
        ahead = [model.start + e[0]]
        for x in e[1:]:
            ahead.append(np.logaddexp.reduce(ahead[-1][:, None] + model.transitions, axis=0) + x)
        behind = [np.zeros(k)]
        for x in reversed(e[1:]):
            behind.insert(0, np.logaddexp.reduce(model.transitions + x + behind[0], axis=1))
        for a, b in zip(ahead, behind, strict=True):
            p = np.exp(a + b - np.logaddexp.reduce(a + b))
            sums += p / p.sum()
    return (model.labels[int(sums.argmax())], sums.max() / len(words)) if words else (language_id.UNDETERMINED, 0.0)


def test_languages_equal_plain_ones(docs, texts):
    rng, labels = np.random.default_rng(3), ["aa", "bb", "cc"]
    lexicons = {w: i % 3 for i, w in enumerate(["the", "le", "und", "de", "que"])}
    model = language_id.LanguageModel(labels, rng.normal(size=(1 << language_id.BUCKET_BITS, 3)), lexicons, rng.normal(size=(4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(docs, model).select("doc_id", F.col("lang_pred"), "score").collect()}
    short = [(i, t) for i, t in texts if len(t or "") < 20_000]
    want = {i: plain_language(model, t) for i, t in short}
    assert [i for i, (name, score) in want.items() if abs(got[i][1] - score) > 1e-4 or (got[i][0] != name and score < got[i][1] - 1e-4)] == []
    assert sum(got[i][0] == name for i, (name, _) in want.items()) >= len(want) - 2
