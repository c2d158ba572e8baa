"""Queries against the SQL that states their results, on the smallest tables."""

import os

import duckdb
import pytest

from loamline.plans import catalogue, harness, lifecycle

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalogue.QUERIES | lifecycle.QUERIES | harness.QUERIES, catalogue.ORACLES | lifecycle.ORACLES | harness.ORACLES
CHOSEN = ["input_classify", "url_canonical", "html_to_text", "html_damaged", "damaged_links", "page_links", "crawl_bfs_capped", "md_sections", "md_markup", "md_containers", "snapshot_hash", "percentiles", "chunk_number", "bm25_phrase", "bm25_postings", "cosine_cells", "variant_extra", "top_groups", *lifecycle.QUERIES, *harness.QUERIES]


def plain(v):
    if isinstance(v, float):
        return round(v, 5)
    return v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    want = db.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    assert got == sorted(str([plain(r[names.index(c)]) for c in columns]) for r in want.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
