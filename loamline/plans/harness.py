"""Registered queries over versions, ingest runs and made benchmark sites, with the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, versions
from ..operators import evaluation
from . import catalogue as c

RUNNING, TARGETS, NOISE, MIB = "1.2.3", 100, 3, 1 << 20
TOPICS = ("scheduling", "storage", "tracing", "routing")


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's number made into a recorded version, some of them none."""
    i = F.col("doc_id")
    tail = F.when(i % 4 == 0, "-rc1").when(i % 4 == 1, "+b.2").when(i % 13 == 5, ".0").otherwise("")
    version = F.concat((i % 3).cast("string"), F.lit("."), (i % 12).cast("string"), F.lit("."), F.when(i % 11 == 7, "x").otherwise((i % 5).cast("string")), tail)
    return c.table(spark, sf_dir, "documents").select("doc_id", F.when(i % 7 != 6, version).alias("recorded"))


def version_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _versions(spark, sf_dir)
    return v.select("doc_id", "recorded", versions.version_order(F.col("recorded"), F.lit(RUNNING)).alias("status"))


def version_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versions(spark, sf_dir).select("doc_id", versions.well_formed(F.col("recorded")).alias("well_formed"))


def version_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    there, readable, recorded = F.col("doc_id") % 10 != 9, F.col("doc_id") % 10 != 8, F.col("recorded")
    return _versions(spark, sf_dir).select(
        "doc_id", versions.installed_status(there, readable, recorded, F.lit(RUNNING)).alias("installed"), versions.replaced_status(there, recorded, F.lit(RUNNING)).alias("replaced")
    )


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events taken for ingest runs."""
    i = F.col("event_id")
    status = F.when(i % 10 == 3, "failed").when(i % 10 == 7, "timeout").otherwise("ok")
    return c.table(spark, sf_dir, "events").select(
        i.alias("index"), status.alias("status"), F.col("value").alias("elapsed_s"), (i % 10).alias("exit_code"), "event_type", F.concat(F.lit("/"), F.col("event_type"), F.lit("/"), i.cast("string")).alias("library_id"),
        F.when(i % 5 != 0, (i % 997) * MIB).alias("max_rss_bytes"), (i * 1000).alias("home_bytes"), (i % 8).alias("page_count"), (i % 50).alias("chunk_count"),
    )


def ingest_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.ingest_totals(_runs(spark, sf_dir))


def first_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.first_failures(_runs(spark, sf_dir)).select("index", "status", "library_id", "exit_code")


def run_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = evaluation.until_stopped(_runs(spark, sf_dir), 990 * MIB, 5 * MIB)
    return kept.groupBy("status").agg(F.count("*").alias("runs"), F.max("index").alias("last"))


def discovery_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers are ranked targets, customers are searched for by nation; several share a URL."""
    key = lambda col, n: F.concat(F.when(F.col(col) % 9 == 4, "").otherwise("/"), F.lit("lib"), (F.col(col) % n).cast("string"))
    url = F.concat(F.lit("https://h.example"), F.col("library_id"))
    ranked = c.table(spark, sf_dir, "supplier").select(key("s_suppkey", 60).alias("library_id"), F.col("s_suppkey").cast("long").alias("position")).withColumn("url", url)
    searched = c.table(spark, sf_dir, "customer").select(key("c_custkey", 700).alias("library_id"), F.col("c_nationkey").cast("int").alias("query_no"), F.col("c_custkey").cast("long").alias("position")).withColumn("url", url)
    return evaluation.discovered(ranked, searched, TARGETS)


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("item_id")
    ident = F.format_string("case-%05d", i)
    return c.table(spark, sf_dir, "benchmark").select(
        ident.alias("id"), F.concat(F.lit("Lib_"), (i % 3).cast("string")).alias("library"), F.concat(F.lit("cases/"), ident, F.lit(".html")).alias("doc_path"), F.concat(F.lit("https://s.example/?a=1&b="), i.cast("string")).alias("source_url"),
        F.when(i % 4 != 1, F.substring_index("text", " ", 3)).alias("llms_summary"), F.col("text").alias("doc_text"),
    )


def bench_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.bench_site(_cases(spark, sf_dir), NOISE, TOPICS).select("path", text.content_hash(F.col("body")).alias("body_hash"))


def case_libraries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.libraries(_cases(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (version_compare, version_format, version_status, ingest_totals, first_failures, run_guard, discovery_fill, bench_site, case_libraries)
}

_VERSIONS = """WITH w AS (SELECT doc_id, CASE WHEN doc_id % 7 <> 6 THEN (doc_id % 3)::VARCHAR || '.' || (doc_id % 12)::VARCHAR || '.' || CASE WHEN doc_id % 11 = 7 THEN 'x' ELSE (doc_id % 5)::VARCHAR END
    || CASE WHEN doc_id % 4 = 0 THEN '-rc1' WHEN doc_id % 4 = 1 THEN '+b.2' WHEN doc_id % 13 = 5 THEN '.0' ELSE '' END END AS recorded FROM documents),
p AS (SELECT *, regexp_extract(recorded, '^([0-9]+)[.]([0-9]+)[.]([0-9]+)([-+].*)?$', ['a', 'b', 'c', 'rest']) AS m FROM w),
n AS (SELECT *, CASE WHEN m.a <> '' THEN [TRY_CAST(m.a AS INT), TRY_CAST(m.b AS INT), TRY_CAST(m.c AS INT)] END AS x FROM p),
o AS (SELECT doc_id, recorded, CASE WHEN x IS NULL THEN 'unknown' WHEN x < [1, 2, 3] THEN 'older' WHEN x = [1, 2, 3] THEN 'same' ELSE 'newer' END AS status FROM n)
"""
_RUNS = f"""WITH r AS (SELECT event_id AS i, CASE WHEN event_id % 10 = 3 THEN 'failed' WHEN event_id % 10 = 7 THEN 'timeout' ELSE 'ok' END AS status, value, event_type,
  CASE WHEN event_id % 5 <> 0 THEN (event_id % 997) * {MIB} END AS rss, event_id * 1000 AS home FROM events)
"""
_ESC = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
_PAGE = "'<html><title>' || {0} || '</title><h2>' || {0} || '</h2><div>' || " + _ESC.format("{2}") + " || '</div><footer>' || {1} || '</footer></html>'"
_CASES = """WITH k AS (SELECT item_id, printf('case-%05d', item_id) AS id, 'Lib_' || (item_id % 3)::VARCHAR AS library, 'lib-' || (item_id % 3)::VARCHAR AS slug, text,
  CASE WHEN item_id % 4 <> 1 THEN array_to_string(string_split(text, ' ')[1:3], ' ') ELSE '' END AS summary FROM benchmark)
"""

ORACLES: dict[str, str] = {
    "version_compare": _VERSIONS + "SELECT doc_id, recorded, status FROM o",
    "version_format": "SELECT doc_id, CASE WHEN doc_id % 7 <> 6 THEN doc_id % 11 <> 7 AND (doc_id % 4 < 2 OR doc_id % 13 <> 5) END AS well_formed FROM documents",
    "version_status": _VERSIONS
    + f"""SELECT doc_id, CASE WHEN doc_id % 10 = 9 THEN 'not_installed' WHEN doc_id % 10 = 8 THEN 'metadata_invalid' WHEN recorded IS NULL THEN 'metadata_missing' WHEN recorded = '{RUNNING}' THEN 'current'
  WHEN status = 'older' THEN 'outdated' ELSE 'version_mismatch' END AS installed,
CASE WHEN doc_id % 10 = 9 THEN 'new_install' WHEN recorded IS NULL THEN 'replaced_untracked_install' WHEN recorded = '{RUNNING}' THEN 'reinstalled_same_version' WHEN status = 'older' THEN 'updated_outdated_install'
  WHEN status = 'newer' THEN 'replaced_newer_install' ELSE 'replaced_different_version' END AS replaced FROM o""",
    "ingest_totals": _RUNS
    + """SELECT count(*) AS attempted, count(*) FILTER (status = 'ok') AS ok, round(avg(value) FILTER (status = 'ok'), 4) AS mean_s, round(stddev_pop(value) FILTER (status = 'ok'), 4) AS stdev_s,
  max(value) FILTER (status = 'ok') AS max_s, max(rss) AS max_rss_bytes, max(home) AS home_bytes, coalesce(sum(i % 8) FILTER (status = 'ok'), 0)::BIGINT AS pages, coalesce(sum(i % 50) FILTER (status = 'ok'), 0)::BIGINT AS chunks FROM r""",
    "first_failures": _RUNS + "SELECT i AS index, status, '/' || event_type || '/' || i::VARCHAR AS library_id, i % 10 AS exit_code FROM r WHERE status <> 'ok' ORDER BY i LIMIT 20",
    "run_guard": _RUNS + f"SELECT status, count(*) AS runs, max(i) AS last FROM r WHERE i <= coalesce((SELECT min(i) FROM r WHERE rss > {990 * MIB} OR home > {5 * MIB}), 9e18) GROUP BY status",
    "discovery_fill": f"""WITH a AS (SELECT 0 AS phase, 0 AS q, s_suppkey::BIGINT AS pos, CASE WHEN s_suppkey % 9 = 4 THEN '' ELSE '/' END || 'lib' || (s_suppkey % 60)::VARCHAR AS lib FROM supplier
  UNION ALL SELECT 1, c_nationkey, c_custkey::BIGINT, CASE WHEN c_custkey % 9 = 4 THEN '' ELSE '/' END || 'lib' || (c_custkey % 700)::VARCHAR FROM customer),
f AS (SELECT *, row_number() OVER (PARTITION BY lib ORDER BY phase, q, pos) AS nth FROM a WHERE lib LIKE '/%'),
p AS (SELECT *, row_number() OVER (ORDER BY phase, q, pos) AS place FROM f WHERE nth = 1)
SELECT place, lib AS library_id, 'https://h.example' || lib AS url, CASE WHEN phase = 0 THEN 'rankings' ELSE 'search' END AS found_by FROM p WHERE place <= {TARGETS}""",
    "bench_site": _CASES
    + ", links AS (SELECT library, slug, ['llms.txt'] || list('cases/' || id || '.html' ORDER BY id) || list_transform(range(" + str(NOISE) + "), lambda j: printf('noise/noise-%03d.html', j)) AS l, string_agg('- [' || id || '](cases/' || id || '.html): ' || summary, chr(10) ORDER BY id) AS lines FROM k GROUP BY ALL),\n"
    + "noise AS (SELECT library, slug, unnest(range(" + str(NOISE) + f")) AS j FROM links), topics AS (SELECT unnest({list(TOPICS)}) AS t),\n"
    + "drawn AS (SELECT library, slug, j, string_agg(t, ' ' ORDER BY md5(library || '/' || j::VARCHAR || '/' || t)) AS said FROM noise, topics GROUP BY ALL),\n"
    + "b AS (SELECT slug || '/cases/' || id || '.html' AS path, " + _PAGE.format("id", "''", "'Source: https://s.example/?a=1&b=' || item_id::VARCHAR || chr(10) || chr(10) || text") + " AS body FROM k\n"
    + "UNION ALL SELECT slug || '/index.html', " + _PAGE.format("library || ' index'", """array_to_string(list_transform(l, lambda u: '<a href=''' || u || '''>' || u || '</a> '), '')""", "'The pages of ' || library || '.'") + " FROM links\n"
    + "UNION ALL SELECT slug || '/llms.txt', '# ' || library || chr(10) || chr(10) || lines FROM links\n"
    + "UNION ALL SELECT slug || printf('/noise/noise-%03d.html', j), " + _PAGE.format("library || ' noise ' || j::VARCHAR", "''", "'Noise of ' || library || ' about ' || said || '.'") + " FROM drawn)\n"
    + "SELECT path, sha256(body) AS body_hash FROM b",
    "case_libraries": _CASES + "SELECT library, count(*) AS cases, min(id) AS first_id FROM k GROUP BY 1",
}
