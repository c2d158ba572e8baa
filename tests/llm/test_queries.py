"""Each opN query on the smallest tables, against its SQL or a plain version."""

import os
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from loamline.llm import language_id, mixing, toxicity
from loamline.llm.queries import ORACLES, QUERIES
from loamline.llm.tokens import default_tokenizer, encoder

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return db


@pytest.fixture(scope="module")
def documents(tables):
    return {d: (t, s, k) for d, t, s, k in tables.execute("SELECT doc_id, text, source, lang FROM documents").fetchall()}


def plain(v):
    return round(v, 5) if isinstance(v, float) else v


def run(spark, name):
    return QUERIES[name](spark, DATA).collect()


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_sql(spark, tables, name):
    got = run(spark, name)
    want = tables.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert set(got[0].asDict()) == set(names)
    assert Counter(str([plain(r[c]) for c in names]) for r in got) == Counter(str([plain(x) for x in r]) for r in want.fetchall())


def test_token_counts(spark, documents):
    ids, want = encoder(default_tokenizer()).ids, defaultdict(Counter)
    for text, source, lang in documents.values():
        if n := len(ids(text)):
            want[source, lang].update(docs=1, tokens=n)
    got = {(r["source"], r["lang"]): (r["docs"], r["tokens"]) for r in run(spark, "op1_token_counts") if r["tokenizer"] == "byte_bpe_50k"}
    assert got == {k: (c["docs"], c["tokens"]) for k, c in want.items()} and len(got) == len(run(spark, "op1_token_counts"))


def test_packing(spark, documents):
    ids, pieces, sequences = encoder(default_tokenizer()).ids, defaultdict(list), defaultdict(list)
    for r in run(spark, "op3_packing"):
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(documents)
    for doc, parts in pieces.items():
        whole, at = np.append(ids(documents[doc][0]), 1).astype("<u4"), 0
        for r in sorted(parts, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(whole)
            assert r["ids_crc32"] == zlib.crc32(whole[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(whole)
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end == 2048 or end & (end - 1) == 0


def test_jaccard_join(spark, documents):
    sets = {}
    for doc, (text, *_) in documents.items():
        w = (text or "").encode().lower().split()
        sets[doc] = {tuple(w[i : i + 4]) for i in range(len(w) - 3)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in sets.items():
        for j, b in sets.items():
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                u, v = find(i), find(j)
                root[max(u, v)] = min(u, v)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in run(spark, "op5_jaccard_join")}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("name, folds, fold, threshold", [("op2_quality_classifier", 5, 0, 0.3), ("op4_toxicity", 3, 1, 0.7), ("op8_language_id", 5, 0, None)])
def test_learned_queries_keep_their_contract(spark, documents, name, folds, fold, threshold):
    got = {r["doc_id"]: r for r in run(spark, name)}
    assert set(got) == set(documents)
    for doc, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(doc).encode()) % folds == fold) and 0 <= r["score"] <= 1
        if threshold is not None:
            assert r["predicted"] == int(r["score"] >= threshold)
        if name == "op4_toxicity":
            assert all(s["score"] >= 0.5 and s["start"] + s["length"] <= len(documents[doc][0].encode()) for s in r["sentences"])
            assert r["score"] >= max([0, *(s["score"] for s in r["sentences"])]) - 1e-9
    if name == "op8_language_id":
        words = {d: len(language_id.words_of(t)) for d, (t, *_) in documents.items()}
        assert all(sum(s["n_words"] for s in r["spans"]) == words[d] and (r["lang_pred"] == "und") == (not words[d]) for d, r in got.items())
        held = [d for d, r in got.items() if r["held_out"] and documents[d][2]]
        assert sum(got[d]["lang_pred"] == documents[d][2] for d in held) >= 0.9 * len(held)


def test_noisy_or():
    model, p = toxicity.ToxicityModel(np.zeros(1 << toxicity.BUCKET_BITS), 0.0), np.array([0.1, 0.25, 0.9])
    assert model.score(p) == pytest.approx(1 - 0.9 * 0.75 * 0.1) and model.score(np.empty(0)) == 0


def test_shards_draw_as_the_hypergeometric_distribution_does(spark):
    quotas = spark.createDataFrame([(0, 60), (1, 40)], "source_rank int, n long").coalesce(1).checkpoint()
    drawn = [next((r["n"] for r in mixing.shard_quotas(quotas, 2, seed).collect() if (r["shard"], r["source_rank"]) == (0, 0)), 0) for seed in range(30)]
    assert abs(np.mean(drawn) - 30) < 1.8 and 2 < np.var(drawn, ddof=1) < 14  # expected: 30 and 6.06
