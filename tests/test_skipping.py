"""Vectors by cell against all of them; pages by host; pages streamed with state."""

import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamline.engine import Engine
from loamline.operators import retrieval, vector_cells
from loamline.sources import fetch
from loamline.sources.page_source import FORMAT, page_source, read_pages
from loamline.streaming.ingest import COUNTED, ingest


def clustered(n=3000, dim=8, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim)) * 4
    rows = [(f"k{i:06d}", [float(x) for x in np.float32(centres[i % 12] + rng.normal(size=dim) * 0.4)]) for i in range(n)]
    odd = [("z0", [0.0] * dim), ("z1", [1.0] * (dim - 2)), ("z2", [2.0] * (dim + 3)), ("z3", None), ("z4", []), ("k000001x", rows[1][1])]
    return [*rows, *odd], centres


def test_cells_give_the_hits_of_all_vectors_and_leave_some_out(spark, tmp_path):
    rows, centres = clustered()
    vectors = spark.createDataFrame(rows, "chunk_key string, embedding array<float>")
    vector_cells.write_cells(vectors, str(tmp_path / "v"), cell_rows=120)
    shares = []
    for query in (centres[0], -centres[1], centres[2] + centres[3], np.zeros(8), np.ones(5)):
        q = [float(x) for x in query]
        found = vector_cells.search_cells(spark, str(tmp_path / "v"), q, 25)
        want = retrieval.top(retrieval.cosine_scores(vectors, q), 25, "rank").collect()
        assert [(r["chunk_key"], r["score"]) for r in found.best.to_pylist()] == [(r["chunk_key"], r["score"]) for r in want]
        shares.append(len(found.read) / found.cells)
    assert min(shares) < 0.35 and shares[3] == 1.0  # a question without an angle reads all


def test_cells_of_no_vectors(spark, tmp_path):
    vector_cells.write_cells(spark.createDataFrame([("a", None)], "chunk_key string, embedding array<float>"), str(tmp_path / "v"))
    assert vector_cells.search_cells(spark, str(tmp_path / "v"), [1.0], 5).best.num_rows == 0


PAGES = {
    "https://a.example/": '<html><body>one <a href="b?x#y">b</a> <a href="https://B.example:443/c">c</a></body></html>',
    "https://a.example/b": "# Text\n[c](https://b.example/c) and https://a.example/.",
    "https://b.example/c": "<main>tail",
}


def answers(pages):
    """A transport that workers get by value."""

    def answer(url):
        if url.endswith("/busy"):
            return fetch.Response(429, b"", retry_after="0")
        return fetch.Response(200, pages[url].encode(), "text/html" if "<" in pages[url] else "text/plain") if url in pages else fetch.Response(404, b"")

    return answer


def test_page_source_gives_the_rows_of_fetch_pages(spark):
    urls = [*PAGES, "https://a.example/busy", "https://c.example/gone", "no url", "https://b.example/c#part"]
    answer = answers(PAGES)
    got = read_pages(spark, urls, answer, 0.0)
    want = fetch.fetch_pages(spark.createDataFrame([(u,) for u in urls], "url string"), answer, 3)
    key = lambda r: r["url"]
    assert got.columns == want.columns
    assert [r for r in sorted(got.collect(), key=key) if r["error"] is None] == [r for r in sorted(want.collect(), key=key) if r["error"] is None]
    assert [(r["url"], r["page_url"], r["error"]) for r in sorted(got.collect(), key=key)] == [(r["url"], r["page_url"], r["error"]) for r in sorted(want.collect(), key=key)]
    assert got.rdd.getNumPartitions() == 4 and read_pages(spark, [], answer).count() == 0


def test_pace_by_host():
    """Calls to one host are a delay apart, also where calls themselves take long; the first is made at once."""
    now, waits, calls = [100.0], [], []

    def slow(url):
        calls.append(now[0])
        now[0] += 3.0 if url.endswith("slow") else 0.25
        return fetch.Response(200, b"x")

    def sleep(seconds):
        waits.append(seconds)
        now[0] += seconds

    urls = [f"https://a.example/{p}" for p in ("1", "2", "slow", "3")] + ["https://b.example/1"]
    reader = page_source(slow, sleep, lambda: now[0])({"urls": json.dumps(urls), "delay": "1"}).reader(None)
    hosts = reader.partitions()
    assert [(h.name, len(h.urls)) for h in hosts] == [("a.example", 4), ("b.example", 1)]
    assert [r[0] for r in reader.read(hosts[0])] == urls[:4]
    assert calls == [100.0, 101.0, 102.0, 105.0] and waits == [0.75, 0.75]


def test_pace_through_spark(spark):
    spark.dataSource.register(page_source(answers(PAGES)))
    began = time.perf_counter()
    rows = spark.read.format(FORMAT).option("urls", json.dumps([*PAGES, "https://a.example/", "https://a.example/b"])).option("delay", "0.5").load().collect()
    assert len(rows) == 5 and time.perf_counter() - began >= 1.5  # four calls to one host


def test_a_snapshot_in_ten_batches_is_indexed_once(spark, tmp_path, monkeypatch):
    engine, landing, calls = Engine(spark, str(tmp_path / "home")), str(tmp_path / "landing"), []
    index = engine.store.index
    monkeypatch.setattr(engine.store, "index", lambda pages: calls.append(sorted(r["page_index"] for r in pages.collect())) or index(pages))
    page = lambda i: ("r1", "s0", "docs", "site", i, f"https://h/{i}", f"page {i} words", 10)
    for i in range(10):  # each file is a micro-batch; some pages come again
        spark.createDataFrame([page(i), *([page(i - 1)] if i % 3 == 2 else [])], COUNTED).coalesce(1).write.mode("append").parquet(landing)
        if i == 4:
            ingest(spark, engine.store, landing, str(tmp_path / "ck"), 1).awaitTermination()
            assert not calls and engine.store.statistics() == (0, 0) and engine.store.pages().count() == 5
    ingest(spark, engine.store, landing, str(tmp_path / "ck"), 1).awaitTermination()
    assert calls == [list(range(10))] and engine.store.pages().count() == 10
    assert [r["url"] for r in engine.store.chunks().orderBy("chunk_index").collect()] == [f"https://h/{i}" for i in range(10)]


@pytest.mark.parametrize("field, want", [("version", "v1"), ("missing", None), ("n", "3")])
def test_facts_of_snapshots(spark, field, want):
    from loamline.sources import files

    rows = spark.createDataFrame([('{"extra": {"version": "v1", "n": 3}}',), ("broken",), (None,)], "m string")
    assert [r["v"] for r in rows.select(files.snapshot_extra(F.col("m"), field).alias("v")).collect()] == [want, None, None]
