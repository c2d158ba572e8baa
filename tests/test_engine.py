"""The engine's commands over a small site and notes, with a transport that answers from a table."""

from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from loamline.engine import Engine
from loamline.functions.embedding import HashingEmbedder
from loamline.functions.urls import in_scope
from loamline.operators.crawl import site
from loamline.operators.numbering import running_total
from loamline.sources import fetch, files
from loamline.streaming.ingest import LANDED, ingest

SITE = {
    "https://d.example/docs/llms.txt": "# Docs\n- [b](https://d.example/docs/b): second\n- [a](https://d.example/docs/a): first\n- [x](https://d.example/other/x)",
    "https://d.example/docs": '<html><body><main>Start <a href="/docs/c">c</a> <a href="/docs/z.png">z</a> <a href="/docs/gone">g</a></main></body></html>',
    "https://d.example/docs/a": "<html><body>alpha retry budget</body></html>",
    "https://d.example/docs/b": '<html><body>beta <a href="a">a</a></body></html>',
    "https://d.example/docs/c": '<html><body>gamma <a href="/docs#top">up</a></body></html>',
    "https://arxiv.org/abs/2401.00001": '<meta name="citation_title" content="Sketches"><meta name="citation_abstract" content="We sketch."><meta property="og:url" content="https://arxiv.org/abs/2401.00001v2">',
    "https://arxiv.org/html/2401.00001": "<html><body><nav>skip</nav><main><article>Full <b>text</b></article></main></body></html>",
}


def answers(pages):
    def transport(url):
        return fetch.Response(200, pages[url].encode(), "text/html" if "<" in pages[url] else "text/plain") if url in pages else fetch.Response(404, b"")

    return transport


class Clock:
    def __init__(self):
        self.n = 0

    def __call__(self):
        self.n += 1
        return datetime(2024, 1, 1, 0, 0, self.n, tzinfo=UTC)


def test_site_order(spark):
    spark.sparkContext.setCheckpointDir(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    bring = lambda urls: fetch.fetch_pages(urls, answers(SITE), 2)
    got = {r["page_index"]: r["url"].rsplit("/", 1)[1] for r in site(spark, "https://d.example/docs", bring).collect()}
    assert got == {0: "llms.txt", 1: "b", 2: "a", 3: "docs", 4: "c"}
    assert site(spark, "https://d.example/docs", bring, 3).count() == 3
    assert site(spark, "https://nothing.example/", bring).count() == 0


RELATIVE = {
    "https://r.example/llms.txt": "# R\n- [guide](guide.md)\n- [api]( api.md#top )\n",
    "https://r.example/": "<h2>Home</h2><p>start</p>",
    "https://r.example/guide.md": "# Guide\nsee [more](sub/more.md) and [api](./api.md?x=1)",
    "https://r.example/api.md": "# API",
    "https://r.example/sub/more.md": "up to [guide](../guide.md)",
}


def test_relative_links_of_text_are_followed(spark):
    spark.sparkContext.setCheckpointDir(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    got = site(spark, "https://r.example/", lambda urls: fetch.fetch_pages(urls, answers(RELATIVE), 2)).collect()
    assert {r["page_index"]: r["url"].rsplit("/", 1)[1] for r in got} == {0: "llms.txt", 1: "guide.md", 2: "api.md", 3: "", 4: "more.md"}
    assert {r["content"] for r in got if r["url"] == "https://r.example/"} == {"Home\nstart\n"}


SPELLED = {
    "https://s.example/docs/llms.txt": "# S\n- [a](https://S.Example:443/docs/x/../a)\n- [evil](https://s.example:443@evil.example/docs/e)\n",
    "https://s.example/docs/a": '<a href="HTTPS://s.example/docs/%2e/a#top">again</a><a href="b c">b</a><a href="https://s.example@evil.example/docs/f">f</a><a href="https:\\\\s.example\\docs\\b%20c?x">b</a>',
    "https://s.example/docs": "<main>home",
    "https://s.example/docs/b%20c": "<main>b",
    "https://evil.example/docs/e": "stolen",
    "https://evil.example/docs/f": "stolen",
}


def test_one_page_for_all_spellings_and_none_of_another_host(spark):
    spark.sparkContext.setCheckpointDir(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    got = site(spark, "https://S.EXAMPLE:443/docs", lambda urls: fetch.fetch_pages(urls, answers(SPELLED), 2)).collect()
    assert {r["page_index"]: r["url"] for r in got} == {0: "https://s.example/docs/llms.txt", 1: "https://s.example/docs/a", 2: "https://s.example/docs", 3: "https://s.example/docs/b%20c"}


def test_scope_of_folders(spark):
    rows = [("https://h/", "https://h/a", True), ("https://h/docs/", "https://h/docs/a", True), ("https://h/docs/", "https://h/docsa", False), ("https://h", "https://h/x/y", True), ("https://h/docs", "https://h:444/docs/a", False)]
    df = spark.createDataFrame(rows, "seed string, link string, want boolean")
    assert df.filter(in_scope(F.col("seed"), F.col("link")) != F.col("want")).count() == 0


def test_fetch_limits():
    waits, left = [], [fetch.Response(429, b"", retry_after="999"), fetch.Response(503, b""), fetch.Response(200, b"ok")]
    assert fetch.get("u", lambda _: left.pop(0), waits.append).body == b"ok" and waits == [10.0, 1.0]
    with pytest.raises(OSError, match="status 429"):
        fetch.get("u", lambda _: fetch.Response(429, b""), lambda _: None)
    with pytest.raises(OSError, match="too large"):
        fetch.get("u", lambda _: fetch.Response(200, b"x" * (fetch.MAX_BODY + 1)))


def test_running_total_over_blocks_and_null_keys(spark):
    rows = [(k, i, i % 3) for k in ("a", None) for i in (0, 1, 4095, 4096, 9000, 70000)]
    df = spark.createDataFrame(rows, "k string, i long, w long")
    got = {(r["k"], r["i"]): r["t"] for r in running_total(df, ["k"], "i", F.col("w"), "t").collect()}
    for k in ("a", None):
        total = 0
        for _, i, w in [r for r in rows if r[0] == k]:
            assert got[k, i] == total
            total += w


def test_commands(spark, tmp_path):
    home, project = str(tmp_path / "home"), str(tmp_path / "project")
    (tmp_path / "project").mkdir()
    note = tmp_path / "notes.md"
    note.write_text("# Guide\n\n## Setup\n\nset the retry budget\n\n## Setup\n\nagain")
    engine = Engine(spark, home, project, answers(SITE), HashingEmbedder(64), Clock())
    docs = engine.add("https://d.example/docs", reason="because")
    notes = engine.add(note.as_uri())
    paper = engine.add("https://arxiv.org/pdf/2401.00001.pdf")
    source = engine.add("https://github.com/o/r", pointer="c0ffee")
    assert [r["label"] for r in (docs, notes, paper, source)] == ["d-example", "notes", "arxiv-2401.00001", "r"]
    with pytest.raises(ValueError):
        engine.add("ftp://x/y")

    listed = {r["label"]: r for r in engine.list().collect()}
    assert listed["d-example"]["page_count"] == 5 and listed["arxiv-2401.00001"]["page_count"] == 2 and listed["notes"]["size_bytes"] > 0
    assert [r["anchor"] for r in engine.store.chunks().filter("kind = 'notes'").orderBy("chunk_index").collect()] == ["guide", "setup", "setup-2"]
    assert engine.store.snapshots.read().filter("kind = 'research_paper'").select(files.snapshot_extra(F.concat(F.lit('{"extra":'), "extra", F.lit("}")), "version")).first()[0] == "v2"
    assert "Version: v2" in engine.store.pages().filter("kind = 'research_paper' AND page_index = 0").first()["content"]

    found = engine.query("retry budget", debug=True).collect()
    assert {r["label"] for r in found} >= {"d-example", "notes"} and any(r["debug"]["lexical_score"] for r in found)
    best = engine.query("retry budget", kind="notes", nested=True).collect()
    assert [r["label"] for r in best] == ["notes"] and best[0]["matched_section_indexes"] and best[0]["evidence"][0]["content"]
    with pytest.raises(LookupError):
        engine.query("retry", label="nothing")
    assert engine.query("retry", kind="source").count() == 0 and engine.query("retry", top_k=0).count() == 0

    assert engine.update("d-example")["changed"] is False
    engine.transport = answers(SITE | {"https://d.example/docs/a": "<html><body>delta retry</body></html>"})
    moved = engine.update("d-example")
    assert moved["changed"] and moved["resource"]["current"] != docs["current"]
    assert [(r["place"], r["is_current"]) for r in engine.history("d-example").orderBy("place").collect()] == [(1, True), (2, False)]
    assert {r["snapshot_id"] for r in engine.query("alpha", label="d-example").collect()} >= {docs["current"]}
    assert docs["current"] not in {r["snapshot_id"] for r in engine.query("alpha", label="d-example", snapshots="current").collect()}
    assert engine.update("r")["changed"] is False and engine.path("r").endswith("c0ffee")

    engine.init()
    assert engine.query("retry").count() == 0  # nothing is linked yet
    engine.link("notes", "mine")
    engine.link("d-example")
    assert files.read_manifest(spark, engine.manifest_path)["resources"][0]["reason"] == "mine"
    assert {r["label"] for r in engine.query("retry").collect()} == {"notes", "d-example"}
    assert engine.use("d-example", docs["current"])["current"] == docs["current"]
    with pytest.raises(LookupError):
        engine.use("d-example", "nothing")
    assert {r["label"]: r["ready"] for r in engine.sync(reindex=True).collect()} == {"notes": True, "d-example": True}
    assert {r["label"] for r in engine.list(project_only=True).collect()} == {"notes", "d-example"}
    engine.unlink("notes")
    assert [r["label"] for r in engine.show().collect()] == ["d-example"]
    gone = engine.remove("d-example", prune=True)
    assert gone["snapshots"] == 2 and gone["pages"] > 5
    assert [r["ready"] for r in engine.sync().collect()] == [False]
    assert engine.doctor()["resources"] == 3


def test_streamed_pages(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "home"), embedder=None)
    landing, row = str(tmp_path / "landing"), ("0012345678901234", "s0", "docs", "site", 0, "u0", "one\n\ntwo")
    spark.createDataFrame([row], LANDED).write.mode("append").parquet(landing)
    ingest(spark, engine.store, landing, str(tmp_path / "ck")).awaitTermination()
    spark.createDataFrame([(*row[:4], 1, "u1", "three")], LANDED).write.mode("append").parquet(landing)
    ingest(spark, engine.store, landing, str(tmp_path / "ck")).awaitTermination()
    got = engine.store.chunks().orderBy("chunk_index").collect()
    assert [(r["resource_id"], r["chunk_index"], r["url"], r["embedding"]) for r in got] == [("0012345678901234", 0, "u0", None), ("0012345678901234", 1, "u1", None)]


def test_files(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s/content.txt").write_text("# u\n\nbody")
    assert files.read_snapshot(spark, str(tmp_path / "s"), "src").first()["url"] == "src"
    (tmp_path / "s/pages.json").write_text('[{"url": "a", "content": "x"}, {"url": "b", "content": "y"}]')
    assert [tuple(r) for r in files.read_snapshot(spark, str(tmp_path / "s"), "src").collect()] == [(0, "a", "x"), (1, "b", "y")]
    (tmp_path / "cases.jsonl").write_text('{"id": "1", "must_include": ["a"]}\n\n{"id": "2", "must_include": []}\n')
    assert files.read_cases(spark, str(tmp_path / "cases.jsonl")).count() == 2 and files.read_cases(spark, str(tmp_path / "cases.jsonl"), 1).count() == 1
    files.append_jsonl(spark.range(1), str(tmp_path / "out"))
    files.append_jsonl(spark.range(2), str(tmp_path / "out"))
    assert files.read_jsonl(spark, str(tmp_path / "out"), "id long").count() == 3
    paths = spark.createDataFrame([('["A"]',), ("broken",), (None,)], "p string").select(files.heading_path_of(F.col("p")).alias("h"))
    assert [r["h"] for r in paths.collect()] == [["A"], [], []]
