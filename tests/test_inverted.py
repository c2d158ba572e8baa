"""The block-wise index: blocks against a plain inversion, scores against a plain BM25, ranges that are left out, statistics."""

import math
import random
import time
from collections import Counter, defaultdict
from datetime import UTC, datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loamline.engine import Engine
from loamline.functions import text
from loamline.operators import inverted, retrieval
from loamline.operators.checkpoints import stored

CHUNKS = "resource_id string, snapshot_id string, chunk_index long, tokens array<string>"


def corpus(n, seed=1):
    """Chunks of two resources in which some words are everywhere and some in few ranges."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice(["the", "of", "a", f"w{rng.randrange(50)}"]) for _ in range(rng.randrange(1, 40))]
        words += ["rare"] * rng.randrange(1, 9) if i % 977 == 5 else []
        words += ["by", "nc"] if i % 400 < 3 else []
        rows.append(("ab"[i % 3 == 0], "s0", i, words))
    return [*rows, ("a", "s0", n, []), ("b", "s1", 0, None)]


def plain_scores(rows, phrases):
    rows = [(r[:3], r[3] or []) for r in rows]
    mean = sum(len(t) for _, t in rows) / len(rows)
    count = lambda t, p: sum(t[i : i + len(p)] == p for i in range(len(t) - len(p) + 1))
    tf = {k: [count(t, p) for p in phrases] for k, t in rows}
    dfs = [sum(1 for v in tf.values() if v[j]) for j in range(len(phrases))]
    out = {}
    for k, t in rows:
        score = 0.0
        for j, _ in enumerate(phrases):
            if tf[k][j]:
                raw = math.log((len(rows) - dfs[j] + 0.5) / (dfs[j] + 0.5))
                score += max(raw, 1e-6) * tf[k][j] * 2.2 / (tf[k][j] + 1.2 * (0.25 + 0.75 * len(t) / mean))
        if any(tf[k]):
            out[k] = round(score, 6)
    return out


@pytest.fixture(scope="module")
def stored_blocks(spark):
    rows = corpus(12_000)
    return rows, stored(inverted.invert(spark.createDataFrame(rows, CHUNKS).repartition(5)))


def test_blocks_hold_the_postings_of_a_range(stored_blocks):
    rows, blocks = stored_blocks
    want = defaultdict(dict)
    for resource, snapshot, i, tokens in rows:
        for term in set(tokens or []):
            want[resource, snapshot, i // inverted.BLOCK, term][i % inverted.BLOCK] = (len(tokens), [k for k, t in enumerate(tokens) if t == term])
    got = {(r["resource_id"], r["snapshot_id"], r["block"], r["term"]): r for r in blocks.filter("block < 4").collect()}
    assert set(got) == {k for k in want if k[2] < 4}
    for k, r in got.items():
        assert {a: (d, p) for a, d, p in zip(r["at"], r["d"], r["positions"], strict=True)} == want[k]
        assert r["n"] == len(want[k]) and r["tf"] == [len(p) for p in r["positions"]]
        pairs = list(zip(r["tf"], r["d"], strict=True))
        front = {(t, d) for t, d in pairs if not any((x >= t and y < d) or (x > t and y <= d) for x, y in pairs)}
        assert {(i["tf"], i["d"]) for i in r["impacts"]} == front


@pytest.mark.parametrize("phrases", [[["rare"]], [["rare"], ["the"], ["w7"]], [["by", "nc"], ["of"], ["nothing"]], [["a", "a", "a"]], [["nothing"]], []])
def test_top_equals_plain_scores(stored_blocks, phrases):
    rows, blocks = stored_blocks
    want = sorted(((-s, k) for k, s in plain_scores(rows, phrases).items()))[:20] if phrases else []
    n, tokens = len(rows), sum(len(r[3] or []) for r in rows)
    found = inverted.bm25_top(blocks, n, tokens, phrases, 20, first=4)
    got = sorted((-r["score"], (r["resource_id"], r["snapshot_id"], r["chunk_index"])) for r in found.best.to_pylist())
    assert [(pytest.approx(s, abs=2e-6), k) for s, k in want] == got


def test_ranges_that_cannot_matter_are_not_decoded(stored_blocks, spark):
    rows, blocks = stored_blocks
    n, tokens = len(rows), sum(len(r[3] or []) for r in rows)
    found = inverted.bm25_top(blocks, n, tokens, [["rare"], ["the"]], 8, first=10)
    ranges = blocks.select(*inverted.RANGE).distinct().count()
    assert found.decoded.count() < 0.5 * ranges and found.frequency["rare"] == 13
    scoped = inverted.bm25_top(blocks, n, tokens, [["rare"], ["the"]], 8, spark.createDataFrame([("b",)], "resource_id string"), first=1)
    want = sorted((-s, k) for k, s in plain_scores(rows, [["rare"], ["the"]]).items() if k[0] == "b")[:8]
    assert sorted((-r["score"], (r["resource_id"], r["snapshot_id"], r["chunk_index"])) for r in scoped.best.to_pylist()) == [(pytest.approx(s, abs=2e-6), k) for s, k in want]


def test_no_chunks(spark):
    none = inverted.invert(spark.createDataFrame([], CHUNKS))
    assert none.count() == 0 and inverted.bm25_top(none, 0, 0, [["a"]], 5).best.num_rows == 0


def test_texts_are_inverted_as_their_tokens(spark, tmp_path):
    """Of Latin-1 and of other letters, without tokens, in several ranges, and as the index is stored."""
    some = ["The cat, the \u00c9t\u00e9.", "", " \u00df\u00b5 x1 \u00bd", "\u4e2d\u6587 the", "\u03a3\u03af\u03c3\u03c5\u03c6\u03bf\u03c2 \u017fo e\u0301 \U0001d400 cat", "\u0130x I\u0307", "--"]
    rows = [("ab"[i % 3 == 0], "s0", i, ["h/1 b", "", "\u03b1 h"][i % 3], some[i % 7]) for i in range(600)]
    rows += [("c", "s0", i, "", "--") for i in range(3)]  # a range without a token
    chunks = spark.createDataFrame(rows, "resource_id string, snapshot_id string, chunk_index long, head string, content string").repartition(3)
    once = text.index_tokens(F.col("content"))
    tokens = chunks.select("resource_id", "snapshot_id", "chunk_index", F.concat(text.index_tokens(F.col("head")), once, once).alias("tokens"))
    shown = lambda df: sorted(str(r) for r in df.select(inverted.invert(tokens).columns).collect())
    want, got = shown(inverted.invert(tokens)), inverted.invert_texts(chunks, len(rows), 2)
    assert want and shown(got) == want
    kept = inverted.stored_blocks(got, str(tmp_path / "blocks"))
    assert shown(kept) == want
    words = ["the", "cat", "\u4e2d\u6587", *[f"none{i}" for i in range(20)]]
    assert shown(kept.filter(inverted._named(words))) == shown(got.filter(F.col("term").isin(words)))


def test_texts_move_once_to_be_inverted(spark):
    chunks = spark.createDataFrame([("a", "s0", 1, "h", "x")], "resource_id string, snapshot_id string, chunk_index long, head string, content string")
    plan = inverted.invert_texts(chunks, 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort ") == 1


def test_a_long_chunk_is_inverted_in_no_time():
    rng = random.Random(2)
    tokens = [f"w{rng.randrange(8000)}" for _ in range(16_000)]
    began = time.perf_counter()
    got = inverted.invert_range(pa.table({"resource_id": ["r"], "snapshot_id": ["s"], "block": [3], "chunk_index": [3 * inverted.BLOCK + 7], "tokens": pa.array([tokens], pa.list_(pa.string()))}))
    assert time.perf_counter() - began < 2 and got.num_rows == len(set(tokens))
    assert sum(got.column("tf").combine_chunks().flatten().to_pylist()) == 16_000


def test_statistics_follow_the_index(spark, tmp_path):
    """Number of chunks and tokens, and frequencies, are those of the chunks after add, update, reindex and remove."""
    ticks = iter(range(60))
    engine = Engine(spark, str(tmp_path / "home"), str(tmp_path), now=lambda: datetime(2024, 1, 1, 0, 0, next(ticks), tzinfo=UTC))
    pages = lambda word, n: spark.createDataFrame([(i, f"https://h/{i}", f"{word} common\n\ntext {i}" * (i + 1)) for i in range(n)], "page_index long, url string, content string")
    engine.init()

    def check():
        chunks = engine.store.chunks()
        assert engine.store.statistics() == (chunks.count(), chunks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0])
        tokens = chunks.select("chunk_key", "tokens")
        words = [["common"], ["one"], ["two"], ["text", "1"]]
        df = Counter()
        for r in retrieval.phrase_counts(tokens, words).collect() if chunks.count() else []:
            df[r["phrase"]] += 1
        n, total = engine.store.statistics()
        assert inverted.bm25_top(engine.store.postings(), n, total, words, 10).frequency == dict(df)
        return n

    engine.add("https://h/one", label="one", pages=pages("one", 4))
    engine.add("https://h/two", label="two", pages=pages("two", 3))
    engine.link("one")
    first = check()
    engine.update("one", pages=pages("one two", 6))
    assert check() > first
    engine.sync(reindex=True)
    check()
    engine.remove("one")
    assert check() == 3
    engine.remove("two", prune=True)
    assert check() == 0
