"""Vector searches and importance resampling against plain versions, on odd tables and in small blocks."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamline.llm.hard_negatives import hard_negatives
from loamline.llm.importance import importance_resample, ring_hashes, words_of
from loamline.llm.top_k import SortedLists, top_k
from loamline.llm.vectors import inner

SCHEMA = "vec_id long, embedding array<float>, label int, id long, v string, row string, score double, asks int, cell int, home int, block int, part int, q int, other int"


def vectors(n, dim=6, seed=1, groups=4):
    """Clustered vectors of several lengths, with copies, ties and repeated ids."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    out = []
    for i in range(n):
        v = (centres[rng.integers(groups)] + rng.normal(size=dim) * 0.3) * rng.choice([0.2, 1, 3])
        out.append((i, [float(x) for x in np.float32(v)], int(rng.integers(3))))
    out += [(5000 + i, list(out[3][1]), i % 3) for i in range(40)]  # copies of one vector
    return [*out, (7, out[9][1], 1), (50, out[11][1], 0), (50, out[12][1], 0)]


ODD = [(900, None, 1), (901, [1.0, None], 1), (902, [float("nan")] * 6, 0), (950, [float("inf")] * 6, 0), (None, [1.0] * 6, 0), (1000, [], 0), (1001, [4.0, 1.0], 1), (1050, [2.0] * 6, None)]


def table(spark, rows):
    given = [(*r, 7, "x", "y", 0.5, 3, 4, 5, 6, 7, 8, 9) for r in rows]
    return spark.createDataFrame(given, SCHEMA)


def whole(rows, dim=6, labelled=False):
    """The rows that take part, as whole numbers."""
    ok = [r for r in rows if r[0] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and (r[2] is not None or not labelled)]
    return [(i, [math.floor(256 * x) for x in v] + [0] * (dim - len(v)), k) for i, v, k in ok]


def plain_top_k(rows, k, asks):
    out = Counter()
    for q in (r for r in whole(rows) if asks(r[0])):
        scored = sorted((-sum(a * b for a, b in zip(q[1], c[1], strict=True)), c[0]) for c in whole(rows) if c[0] != q[0])
        out.update((q[0], n + 1, i, -s) for n, (s, i) in enumerate(scored[:k]))
    return out


def plain_negatives(rows, asks, positives=5, negatives=3):
    out, held = Counter(), whole(rows, labelled=True)
    for q in (r for r in held if asks(r[0])):
        scored = sorted((-sum(a * b for a, b in zip(q[1], c[1], strict=True)), c[0], c[2]) for c in held if c[0] != q[0])
        for s, i, _ in [x for x in scored if x[2] == q[2]][:positives]:
            fit = [(t, j) for t, j, k in scored if k != q[2] and 50 * -s <= 100 * -t <= 95 * -s]
            out.update((q[0], i, n + 1, j, -s, -t) for n, (t, j) in enumerate(fit[:negatives]))
    return out


@pytest.mark.parametrize("block_rows, query_rows", [(4096, 1024), (60, 5)])
def test_top_k_equals_brute_force(spark, block_rows, query_rows):
    rows = vectors(300) + ODD
    got = top_k(table(spark, rows), F.col("vec_id") % 10 == 0, 4, block_rows=block_rows, query_rows=query_rows)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert Counter(map(tuple, got.collect())) == plain_top_k(rows, 4, lambda i: i % 10 == 0)


def test_sorted_lists_stop_early_and_lose_nothing():
    rng = np.random.default_rng(5)
    values = rng.integers(-3000, 3000, size=(4000, 4)) * (rng.random((4000, 1)) < 0.1)
    lists, read = SortedLists(values), []
    for _ in range(20):
        query = rng.integers(-500, 500, 4)
        scores = values @ query
        for floor in (-np.inf, float(np.sort(scores)[-3])):
            near, entries = lists.search(query, 5, floor)
            read.append(entries / values.size)
            best = np.sort(scores)[-5:]
            assert set(np.flatnonzero(scores >= max(best[0], floor))) <= set(near)
    assert np.mean(read) < 0.5  # most entries are never read


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 50, "anchor_rows": 6, "pivot_anchors": 5}])
def test_hard_negatives_equal_brute_force(spark, sizes):
    rows = vectors(300) + ODD
    got = hard_negatives(table(spark, rows), F.col("vec_id") % 10 == 0, **sizes)
    assert Counter(map(tuple, got.collect())) == plain_negatives(rows, lambda i: i % 10 == 0)


def test_hard_negatives_with_few_partners_and_text_labels(spark):
    rows = [(0, [1.0, 0.0], "a"), (1, [0.9, 0.1], "a"), (2, [0.8, 0.0], "b"), (3, [-1.0, 0.0], "b"), (10, [0.0, 1.0], "c")]
    given = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = hard_negatives(given, F.col("vec_id") % 10 == 0).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 2, 256 * 230, 256 * 204)]


@pytest.mark.parametrize("rows", [[], ODD[:4]])
def test_vector_operators_without_rows(spark, rows):
    assert top_k(table(spark, rows), F.lit(True)).count() == 0
    assert hard_negatives(table(spark, rows), F.lit(True)).count() == 0


def test_scores_beyond_doubles_are_exact_and_beyond_64_bits_an_error():
    a = np.array([[1 << 30, 3], [5, (1 << 30) + 1]])
    assert inner(a, a).tolist() == [[(1 << 60) + 9, 8 * (1 << 30) + 3], [8 * (1 << 30) + 3, 25 + ((1 << 30) + 1) ** 2]]
    with pytest.raises(ValueError):
        inner(a << 10, a)


def plain_resample(docs, target, n, buckets, percent, min_words):
    runs = lambda t: [" ".join(w[i : i + k]) for w in [plain_words(t)] for k in range(1, n + 1) for i in range(len(w) - k + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for text in c for f in runs(text)) for c in ([d[1] for d in docs], target))
    size = lambda c: sum(c.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * size(s) / ((s[b] + 1) * size(t))))
    rows = []
    for doc, text in docs:
        found = runs(text)
        weight = sum(gain(bucket(f)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append([doc, len(plain_words(text)), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    able = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = defaultdict(list)
    for i, r in enumerate(able[: len(able) * percent // 100]):
        drawn[tuple(r)].append(i + 1)
    return Counter((*r, drawn[tuple(r)].pop(0) if drawn[tuple(r)] else None) for r in sorted(rows, key=lambda r: -r[1]))


def plain_words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c.isascii() and not c.isalnum():
            out += [word] if word else []
            word = ""
        else:
            word += c.lower() if c.isascii() else c
    return out


@pytest.mark.parametrize("n, buckets, percent, min_words", [(1, 10_000, 10, 20), (3, 97, 40, 2), (2, 70_000, 100, 0)])
def test_importance_resample_equals_brute_force(spark, n, buckets, percent, min_words):
    rng = random.Random(n)
    words = ["aa", "Bb", "éc", "d9", "x_y", "ÉC", "…", "q"]
    text = lambda k: "".join(rng.choice(words) + rng.choice([" ", "-", "\n", " . "]) for _ in range(k))
    docs = [(i, text(rng.randrange(60))) for i in range(120)] + [(5, text(30)), (6, text(30)), (None, text(40)), (None, text(40)), (300, None), (301, ""), (302, " .,\t"), (303, text(60_000))]
    docs += [(400, "same words again and again " * 8)] * 30
    target = [text(25) for _ in range(9)] + [None]
    given = spark.createDataFrame([(*d, 1, 2, 3, 4, 5, 6) for d in docs], "doc_id long, text string, id int, rank int, buckets int, lm_row int, weight int, n int")
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance_resample(given, bench, n=n, buckets=buckets, percent=percent, min_words=min_words)
    want = plain_resample(docs, target, n, buckets, percent, min_words)
    assert Counter(map(tuple, got.collect())) == want and sum(1 for r in want.elements() if r[5]) > 3


def test_importance_resample_without_rows(spark):
    none, some = spark.createDataFrame([], "doc_id string, text string"), spark.createDataFrame([("a1", "b c " * 20)], "doc_id string, text string")
    assert importance_resample(none, some.select("text")).count() == 0
    assert [r["rank"] for r in importance_resample(some, none.select("text"), percent=100).collect()] == [1]


def test_ring_hashes_are_those_of_whole_runs():
    words = words_of("One, two-three ÄÖ four 5".encode())
    want = [zlib.crc32(b" ".join(words[i : j + 1])) for j in range(len(words)) for i in range(max(0, j - 3), j + 1)]
    assert list(ring_hashes(words, 4)) == want and list(ring_hashes(words, 1)) == [zlib.crc32(w) for w in words]


def test_a_known_floor_reads_the_lists_once_and_bounds_are_tight():
    rng = np.random.default_rng(9)
    values = rng.integers(-300, 300, size=(500, 8))
    lists, reads = SortedLists(values), []
    plain = lists._read
    lists._read = lambda q, begin, end, given: reads.append((begin, end)) or plain(q, begin, end, given)
    for query in rng.integers(-50, 50, size=(20, 8)):
        scores = values @ query
        near, _ = lists.search(query, 5, float(np.sort(scores)[-5]))
        assert set(np.flatnonzero(scores >= np.sort(scores)[-5])) <= set(near)
        assert lists.scores(query, near).tolist() == scores[near].tolist()
    assert len(reads) <= 20 and all(begin == 0 for begin, _ in reads)
    huge = SortedLists(values << 36)  # beyond what doubles hold
    assert huge.scores(values[0], np.arange(500)).tolist() == ((values << 36) @ values[0]).tolist()


def test_anchors_travel_and_no_task_holds_more_than_bounded_scores(spark, monkeypatch):
    """A candidate is placed once, in its own cell; however many cells there are, its vector is not copied to them."""
    from loamline.llm import hard_negatives as module

    rows, seen = vectors(300), []
    plain = module.settled
    monkeypatch.setattr(module, "settled", lambda df: seen.append(plain(df)) or seen[-1])
    got = hard_negatives(table(spark, rows), F.col("vec_id") % 10 == 0, pivot_anchors=1)
    assert Counter(map(tuple, got.collect())) == plain_negatives(rows, lambda i: i % 10 == 0)
    copies = [df.count() for df in seen if "v" in df.columns]
    assert sum(copies) == len(rows) + sum(1 for r in rows if r[0] % 10 == 0)
    left, right = (module.pa.table({"x": list(range(n))}) for n in (5000, 4096))
    held = module._slices(left, right)
    assert held[0].start == 0 and all((s.stop - s.start) * 4096 <= module.SCORES for s in held) and held[-1].stop >= 5000
