"""Snapshot folders, pinned model files, registries, the store's health and the harness's reports."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamline.engine import Engine
from loamline.functions.embedding import passage_vectors
from loamline.operators import evaluation
from loamline.sources import files, models, snapshots
from loamline.sources.registries import Arxiv


def test_snapshot_folder_round_trip(spark, tmp_path):
    rows = [(1, "u1", "zwei\n\"x\""), (0, "u0", "eins ü"), (2, None, "lost"), (3, "u3", None)]
    pages = spark.createDataFrame(rows, "page_index long, url string, content string")
    made = snapshots.write_snapshot(pages, str(tmp_path), "research_paper", "r1", "src", "2024-01-02T03:04:05Z", {"version": "v2"})
    digest = hashlib.sha256("u0\neins ü\nu1\nzwei\n\"x\"\n".encode()).hexdigest()
    assert made["content_hash"] == f"sha256:{digest}" and made["snapshot_id"] == f"20240102T030405Z-{digest[:12]}" and made["page_count"] == 4
    at = tmp_path / "research_papers" / "r1" / made["snapshot_id"]
    assert (at / "content.txt").read_text() == "# u0\n\neins ü\n\n# u1\n\nzwei\n\"x\"\n\n"
    assert json.loads((at / "snapshot.json").read_text()) == made
    assert [tuple(r) for r in files.read_snapshot(spark, str(at), "src").orderBy("page_index").collect()] == sorted(rows)
    again = snapshots.write_snapshot(pages, str(tmp_path), "research_paper", "r1", "src", "2024-01-02T03:04:05Z", {"version": "v2"})
    assert again == made and [p.name for p in (tmp_path / "research_papers" / "r1").iterdir() if not p.name.startswith(".")] == [made["snapshot_id"]]
    empty = snapshots.write_snapshot(pages.limit(0), str(tmp_path), "docs", "r2", "src", "2024-01-02T03:04:05Z")
    assert empty["page_count"] == 0 and files.read_snapshot(spark, empty["path"], "src").count() == 0
    with pytest.raises(ValueError):
        snapshots.write_snapshot(pages, str(tmp_path), "source", "r", "u", "t")


def test_pinned_model_files(spark, tmp_path):
    (tmp_path / models.VOCABULARY).write_text("passage:\nred\nblue\n")
    np.save(tmp_path / models.VECTORS, np.array([[0, 0], [3, 4], [0, 2]], np.float32))
    pins = {n: hashlib.sha256((tmp_path / n).read_bytes()).hexdigest() for n in (models.VOCABULARY, models.VECTORS)}
    embedder = models.VectorFiles(spark, str(tmp_path), pins)
    rows = spark.createDataFrame([("red",), ("nothing",), (None,)], "t string").select(passage_vectors(F.col("t"), embedder).alias("v")).collect()
    assert np.allclose(rows[0]["v"], [0.6, 0.8]) and rows[1]["v"] == [0, 0] and rows[2]["v"] is None
    with pytest.raises(ValueError, match=models.VECTORS):
        models.verified(spark, str(tmp_path), pins | {models.VECTORS: "0" * 64})
    with pytest.raises(ValueError, match="gone"):
        models.verified(spark, str(tmp_path), pins | {"gone": "0" * 64})


class Shelf:
    """A registry of papers that are their own number."""

    name, prefix = "shelf", "https://shelf.example/paper/"

    def paper(self, url):
        return F.regexp_extract(url, "^https://shelf.example/(?:paper|read)/([0-9]+)$", 1)

    def pages(self, spark, paper, transport):
        return spark.createDataFrame([(0, self.prefix + paper, f"paper number {paper} on budgets")], "page_index long, url string, content string"), "v7"


def test_registries_export_and_health(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "home"), registries=(Shelf(), Arxiv()))
    assert engine.doctor()["layout"]["status"] == "not_installed"
    row = engine.add("https://shelf.example/read/12")
    assert (row["label"], row["kind"], row["url"]) == ("shelf-12", "research_paper", "https://shelf.example/paper/12")
    assert engine.update("shelf-12")["changed"] is False
    with pytest.raises(ValueError):
        engine.add("https://arxiv.org/list/cs")
    for scope in ("post_limit", "pre_limit"):
        assert [r["label"] for r in engine.query("budgets", scope=scope).collect()] == ["shelf-12"] and engine.query("nowhere", scope=scope).count() == 0
    assert engine.query("budgets", kind="docs").count() == 0
    made = engine.export("shelf-12", str(tmp_path / "out"))
    assert made["extra"] == {"registry": "shelf", "version": "v7"} and made["snapshot_id"] == row["current"] and made["content_hash"] == engine.store.snapshots.read().first()["content_hash"]
    well = engine.doctor()
    assert well["healthy"] and well["layout"]["status"] == "current"
    engine.files.delete(f"{engine.store.home}/postings")
    engine.files.write_text(f"{engine.store.home}/store.json", '{"version": "0.9.9"}')
    ill = engine.doctor()
    assert not ill["healthy"] and ill["layout"]["status"] == "outdated" and ill["problems"] == {"resources_without_snapshot": 0, "snapshots_without_pages": 0, "snapshots_without_postings": 1}
    engine.files.write_text(f"{engine.store.home}/store.json", "broken")
    assert engine.doctor()["layout"]["status"] == "metadata_invalid"


RUN = "index long, status string, elapsed_s double, exit_code long, library_id string, max_rss_bytes long, home_bytes long, page_count long, chunk_count long"


def test_ingest_report(spark):
    spark.sparkContext.setCheckpointDir(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    rows = [(1, "ok", 2.0, 0, "/a", None, 10, 3, 7), (2, "timeout", 9.0, 124, "/b", 2 << 20, 3 << 20, 0, 0), (3, "ok", 4.0, 0, "/c", 1 << 20, None, 2, 1)]
    report = evaluation.ingest_report(spark.createDataFrame(rows, RUN))
    assert "* runs: 3 (ok 2, timeout 1)" in report and "p50 2.00 s, p90 4.00 s, max 4.00 s, mean 3.00 s, deviation 1.00 s" in report
    assert "most memory: 2.0 MiB; store: 3.0 MiB" in report and "5 pages, 8 chunks" in report
    assert report.index("4.00 s /c") < report.index("2.00 s /a") < report.index("* timeout /b, exit code 124")
    assert "* runs: 0 ()" in evaluation.ingest_report(spark.createDataFrame([], RUN))
    runs = spark.createDataFrame(rows, RUN)
    assert evaluation.until_stopped(runs, 1 << 20, 1 << 40).count() == 2 and evaluation.until_stopped(runs, 1 << 40, 1 << 40).count() == 3


def test_made_site(spark):
    case = {"id": "x<1>", "library": "My Lib", "doc_path": "a/b.html", "source_url": None, "llms_summary": None, "doc_text": "a & b"}
    schema = ", ".join(f"{k} string" for k in case)
    got = {r["path"]: r["body"] for r in evaluation.bench_site(spark.createDataFrame([case], schema)).collect()}
    assert set(got) == {"my-lib/a/b.html", "my-lib/index.html", "my-lib/llms.txt"}
    assert "<h2>x&lt;1&gt;</h2>" in got["my-lib/a/b.html"] and "a &amp; b</div>" in got["my-lib/a/b.html"] and got["my-lib/llms.txt"].endswith("- [x<1>](a/b.html): ")
    for path in ("/etc/x", "a/../../x"):
        with pytest.raises(Exception, match="leaves its site"):
            evaluation.bench_site(spark.createDataFrame([case | {"doc_path": path}], schema)).collect()
    assert evaluation.bench_site(spark.createDataFrame([], schema), 2).count() == 0
