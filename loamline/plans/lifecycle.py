"""Registered queries over searches, papers, catalog views and harness summaries, with the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable
from string import Formatter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import embedding, html, papers, text, urls
from ..operators import catalog, chunking, evaluation, retrieval
from . import catalogue as c

SMALL_BUDGET = 2000


def _groups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    chunks, anchored = c.anchored(spark, sf_dir)
    return chunks, retrieval.groups(anchored)


def context_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.context_ranges(_groups(spark, sf_dir)[1]).select("rank", "url", "first_chunk", "last_chunk")


def budget_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, chosen = _groups(spark, sf_dir)
    return retrieval.within_budget(retrieval.context(chosen, chunks), SMALL_BUDGET).select("rank", "chunk_index", F.col("total").alias("tokens_so_far"))


def evidence_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole search over a corpus with vectors, its evidence put together as by the engine's query."""
    best, near, some = c.ranked(spark, sf_dir)
    chunks = c.stored(chunking.page_chunks(c.corpus_texts(spark, sf_dir, some).withColumn("kind", F.lit("docs")), "first_chunk"))
    found = retrieval.evidence_for(best.orderBy("lexical_rank").toArrow(), near, chunks, c.TERMS)  # a candidate limit of rows
    return found.select("rank", "kind", "label", "citation", "group_score", "chunk_index", "evidence", "content_hash", "score", "lexical_rank", "vector_rank")


def note_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = c.notes(spark, sf_dir, False)
    of = F.col("conv_id").cast("string")
    pages = n.select("conv_id", of.alias("resource_id"), F.lit("s0").alias("snapshot_id"), F.lit("notes").alias("kind"), of.alias("label"), of.alias("url"), F.lit(0).cast("long").alias("page_index"), F.col("markdown").alias("content"))
    return chunking.page_chunks(pages).select("conv_id", "chunk_index", "section_index", "anchor")


def snapshot_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = c.snapshot_hash(spark, sf_dir).withColumn("fetched_at", F.col("snapshot_id"))
    return catalog.history(c.resources(spark, sf_dir), s).select("label", "snapshot_id", "place", "is_current")


def link_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = c.resources(spark, sf_dir)
    return catalog.linked(r, r.filter("label < 'src2'")).select("id", "label", "linked")


def queryable_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = c.resources(spark, sf_dir).withColumn("kind", F.when(F.col("label") == "src3", "source").when(F.col("label") == "src4", "notes").otherwise(F.col("kind")))
    return catalog.queryable(r).select("label", "kind")


def llms_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    llms = F.regexp_replace("url", "[^/]*$", "llms.txt")
    rows = c.table(spark, sf_dir, "pages").select("page_id", llms.alias("llms"), F.explode(html.html_links(F.col("html"), F.col("url"))).alias("link"))
    return rows.select("page_id", "link", urls.in_llms_scope(F.col("llms"), F.col("link")).alias("in_scope"))


def _parts() -> tuple[F.Column, F.Column, F.Column]:
    """Scheme, host and path of a page's URL, taken apart as the SQL does it."""
    cut = lambda i: F.regexp_extract("url", r"^([a-z]+)://([^/?#]*)([^?#]*)", i)
    return cut(1), cut(2), cut(3)


#: How a page's URL is spelled anew, and what the spelling is by the standard: text with {scheme}, {host}, {path}, ...
SPELLINGS = [
    ("case", "{SCHEME}://{HOST}{path}", "{scheme}://{host}{path}"),
    ("default port", "{scheme}://{host}:{port}{path}", "{scheme}://{host}{path}"),
    ("other port", "{scheme}://{host}:08080{path}", "{scheme}://{host}:8080{path}"),
    ("no port", "{scheme}://{host}:{path}", "{scheme}://{host}{path}"),
    ("dots", "{scheme}://{host}/x/.././y/..{path}", "{scheme}://{host}{path}"),
    ("coded dots", "{scheme}://{host}/x/y/%2E%2e/.%2E{path}/%2e", "{scheme}://{host}{path}/"),
    ("space", " {scheme}:/\t/{host}\n{path} ", "{scheme}://{host}{path}"),
    ("backslashes", "{scheme}:\\\\{host}\\a\\..{path}", "{scheme}://{host}{path}"),
    ("slashes", "{scheme}:/{host}{path}", "{scheme}://{host}{path}"),
    ("user", "{scheme}://u:p@{host}{path}", "{scheme}://u:p@{host}{path}"),
    ("user host", "{scheme}://{host}:{port}@evil.example{path}", "{scheme}://{host}:{port}@evil.example{path}"),
    ("query", "{scheme}://{host}{path}?a=b#c?d", "{scheme}://{host}{path}"),
    ("escapes", "{scheme}://{host}{path}/a b\"<`{{é%zz|", "{scheme}://{host}{path}/a%20b%22%3C%60%7B%C3%A9%zz|"),
    ("letters", "{scheme}://Bücher。{host}{path}", "{scheme}://xn--bcher-kva.{host}{path}"),
    ("coded host", "{scheme}://%41%2e{host}{path}", "{scheme}://a.{host}{path}"),
    ("numbers", "{scheme}://0x7f.0.257{path}", "{scheme}://127.0.1.1{path}"),
    ("fields", "{scheme}://[2001:DB8:0:0:1:0:0:1]:{port}{path}", "{scheme}://[2001:db8::1:0:0:1]{path}"),
    ("no host", "{scheme}://a b{path}", "{scheme}://a b{path}"),
    ("no such port", "{scheme}://{host}:65536{path}", "{scheme}://{host}:65536{path}"),
]


def _spelled(template: str) -> F.Column:
    scheme, host, path = _parts()
    port = F.when(scheme == "https", "443").otherwise("80")
    known = {"scheme": scheme, "host": host, "path": path, "port": port, "SCHEME": F.upper(scheme), "HOST": F.upper(host)}
    parts = Formatter().parse(template)
    return F.concat(*[x for text_, name, *_ in parts for x in ([F.lit(text_)] if text_ else []) + ([known[name]] if name else [])])


def url_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL in other spellings: the canonical form, and whether it is then the page's own."""
    each = F.array(*[F.struct(F.lit(name).alias("spelling"), _spelled(given).alias("given")) for name, given, _ in SPELLINGS])
    rows = c.table(spark, sf_dir, "pages").select("page_id", "url", F.inline(each))
    canonical = urls.canonical_url(F.col("given"))
    return rows.select("page_id", "spelling", canonical.alias("canonical"), (canonical == urls.canonical_url(F.col("url"))).alias("same_page"))


#: Links seen by a crawl from {scheme}://{host}/s, and whether it may follow them.
HOSTILE = [
    ("below", "{scheme}://{host}/s/a", True),
    ("case and port", "{SCHEME}://{HOST}:{port}/s/a", True),
    ("dots inside", "{scheme}://{host}/x/../s/a", True),
    ("user", "{scheme}://u@{host}/s/a", True),
    ("host as user", "{scheme}://{host}@evil.example/s/a", False),
    ("host and port as user", "{scheme}://{host}:{port}@evil.example/s/a", False),
    ("host as path", "{scheme}://evil.example\\@{host}/s/a", False),
    ("host as query", "{scheme}://evil.example?@{host}/s/a", False),
    ("longer host", "{scheme}://{host}.evil.example/s/a", False),
    ("dots", "{scheme}://{host}/s/../a", False),
    ("coded dots", "{scheme}://{host}/s/%2E%2e/a", False),
    ("other port", "{scheme}://{host}:444/s/a", False),
    ("other scheme", "ws{scheme}://{host}/s/a", False),
    ("beside", "{scheme}://{host}/sa", False),
    ("asset", "{scheme}://{host}/s/a.%70NG?x", True),
    ("plain asset", "{scheme}://{host}/s/a.pNG?x", False),
    ("no URL", "{scheme}://[{host}]/s/a", False),
]


def scope_hostile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that pretend to be of a page's host: whether a crawl, and an llms.txt, may follow them."""
    each = F.array(*[F.struct(F.lit(name).alias("link"), _spelled(given).alias("given")) for name, given, _ in HOSTILE])
    rows = c.table(spark, sf_dir, "pages").select("page_id", _spelled("{scheme}://{host}/s").alias("seed"), F.inline(each))
    llms = F.concat("seed", F.lit("/llms.txt"))
    return rows.select("page_id", "link", urls.in_scope(F.col("seed"), F.col("given")).alias("in_scope"), urls.in_llms_scope(llms, F.col("given")).alias("in_llms_scope"))


#: Inputs of each kind that hold a page's number, and their names.
NAMED = [
    ("https://github.com/o/r{i}.git/tree/main", "r{i}"),
    ("https://arxiv.org/abs/hep-th/{i}", "arxiv-hep-th-{i}"),
    ("https://www.h{i}.Example.org:8080/docs", "h{i}-example-org"),
    ("file:///tmp/my.{i}.md", "my.{i}"),
]


def _numbered(template: str, number: F.Column) -> F.Column:
    before, _, after = template.partition("{i}")
    return F.concat(F.lit(before), number.cast("string"), F.lit(after))


def input_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of inputs made of every page's number."""
    made = F.array(*[_numbered(u, F.col("page_id")) for u, _ in NAMED])
    rows = c.table(spark, sf_dir, "pages").select("page_id", F.explode(made).alias("given"))
    return rows.select("page_id", "given", urls.default_name(F.col("given")).alias("label"))


def retry_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events taken for refused calls: some servers say how long to wait, in seconds or in words."""
    i = F.col("event_id")
    asked = F.when(i % 4 == 1, (i % 30).cast("string")).when(i % 4 == 2, F.lit("soon"))
    return c.table(spark, sf_dir, "events").select("event_id", urls.retry_seconds(asked, (i % 8).cast("int")).alias("seconds"))


def paper_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages taken for papers' landing pages: full ones, bare ones with a version in their id, and bare ones."""
    i = F.col("page_id").cast("string")
    full = ['<html><head><meta name="citation_title" content=" On Sets &amp; Bags ', i, ' "><meta name="citation_author" content="Roe, A"><meta name="citation_author" content="Poe, ', i, '">']
    full += ['<meta name="citation_date" content="2024/01/01"><meta property="og:url" content="https://arxiv.org/abs/', i, 'v3"><meta property="og:description" content="We count to ', i, '."></head></html>']
    bare = ['<meta property="og:title" content="T', i, '"><meta name="citation_abstract" content="A"><meta name="citation_pdf_url" content="https://arxiv.org/pdf/', i, 'v1">']
    made = lambda parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    ident = F.when(F.col("page_id") % 3 == 1, F.concat(i, F.lit("v1"))).otherwise(i)
    d = c.table(spark, sf_dir, "pages").select("page_id", ident.alias("id"), F.when(F.col("page_id") % 3 == 0, made(full)).otherwise(made(bare)).alias("html"))
    d = d.withColumn("paper", papers.paper_metadata(F.col("html")))
    d = d.withColumn("version", F.coalesce(papers.paper_version(F.col("paper.page_url")), papers.paper_version(F.col("id"))))
    return d.select("page_id", "version", papers.paper_header(F.col("id"), F.col("version"), F.col("paper")).alias("header"))


def embed_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = c.table(spark, sf_dir, "documents").select("doc_id", embedding.passage_vectors(F.col("text"), embedding.HashingEmbedder()).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return d.select("doc_id", F.size("v").alias("dims"), F.round(norm, 4).alias("norm"), (embedding.from_bytes(embedding.to_bytes(F.col("v"))) == F.col("v")).alias("round_trip"))


def bench_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("item_id")
    said = F.when(i % 3 == 0, "rrf_hybrid").otherwise(F.concat(F.lit("RRF_hybrid source_prior: llms_txt "), F.translate("text", text.LOWER, text.UPPER)))
    cases = c.table(spark, sf_dir, "benchmark").select(
        F.when(i % 2 == 0, "small").otherwise("large").alias("mode"), F.split("text", " ").alias("must_include"), said.alias("output"), F.when(i % 7 == 6, 1).otherwise(0).alias("exit_code"), i.cast("double").alias("elapsed_s")
    )
    return evaluation.case_summary(evaluation.judged(cases))


def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events taken for runs with a timing report each: its two forms, a broken one, and none."""
    i = F.col("event_id")
    n = (i * 7).cast("string")
    said = F.element_at(F.array(*[F.lit(x) for x in ("HTTP 429", "403 Forbidden", "error", "captcha")]), (i % 4 + 1).cast("int"))
    line = F.when(i % 4 == 0, F.concat(F.lit("  "), n, F.lit("  maximum resident set size"))).when(i % 4 == 1, F.concat(F.lit("\tMaximum resident set size (kbytes): "), n)).when(i % 4 == 2, F.lit("Maximum resident set size (kbytes): x"))
    return c.table(spark, sf_dir, "events").select("event_id", evaluation.run_status(i % 5, said, i % 11 == 0).alias("status"), evaluation.max_rss_bytes(line).alias("max_rss_bytes"))


def target_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = c.table(spark, sf_dir, "pages").select("page_id", urls.host(F.col("url")).alias("host"))
    return evaluation.first_targets(p, "host", ["page_id"])


def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.table_counts(c.table(spark, sf_dir, "embeddings"), "embedding")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        context_ranges, budget_pack, evidence_items, note_chunks, snapshot_history, link_status, queryable_scope, llms_scope, url_spellings, scope_hostile, input_names, retry_delays, paper_header,
        embed_passages, bench_summary, run_status, target_discovery, table_counts,
    )
}


def _sql(template: str) -> str:
    """A spelling as SQL over s, h, p, the parts of a page's URL, and o, its scheme's port."""
    known = {"scheme": "s", "host": "h", "path": "p", "port": "o", "SCHEME": "upper(s)", "HOST": "upper(h)"}
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return " || ".join(x for text_, name, *_ in Formatter().parse(template) for x in ([quoted(text_)] if text_ else []) + ([known[name]] if name else []))


_URL_CTE = r"""u AS (SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS s, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS h, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p FROM pages),
w AS (SELECT *, CASE WHEN s = 'https' THEN '443' ELSE '80' END AS o FROM u)"""

_SEARCH = c._BM25 + c.VECTOR_CTE + c.ANCHOR_CTE

ORACLES: dict[str, str] = {
    "context_ranges": c.catalogue_sql(
        _SEARCH + r""",
an AS (SELECT rank, url, unnest(a) AS x FROM topg), st AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY rank ORDER BY x) <= 5 THEN 0 ELSE 1 END AS s FROM an),
isl AS (SELECT *, sum(s) OVER (PARTITION BY rank ORDER BY x) AS k FROM st)""",
        "SELECT rank, url, greatest(min(x) - 2, 0) AS first_chunk, max(x) + 2 AS last_chunk FROM isl GROUP BY rank, url, k",
    ),
    "budget_pack": c.catalogue_sql(_SEARCH, f"SELECT e.rank, e.chunk_index, b.total AS tokens_so_far FROM ev e JOIN bud b USING (rank) WHERE e.rank = 1 OR b.total <= {SMALL_BUDGET}"),
    "evidence_items": c.catalogue_sql(
        _SEARCH,
        """SELECT e.rank, 'docs' AS kind, k.label, e.url AS citation, g.group_score, e.chunk_index, e.evidence, sha256(e.content) AS content_hash, a.score, a.lexical_rank, a.vector_rank
FROM ev e JOIN bud b USING (rank) JOIN topg g ON g.rank = e.rank JOIN chunks k ON k.url = e.url AND k.chunk_index = e.chunk_index LEFT JOIN anch a ON a.chunk_key = k.chunk_key WHERE e.rank = 1 OR b.total <= 20000""",
    ),
    "note_chunks": "SELECT conv_id, section_index AS chunk_index, section_index, anchor FROM (" + c.ORACLES["md_anchor"] + ")",
    "snapshot_history": c.catalogue_sql(c.HASH_CTE, "SELECT label, snapshot_id, row_number() OVER (PARTITION BY resource_id ORDER BY snapshot_id DESC) AS place, coalesce(snapshot_id = current, false) AS is_current FROM snaps JOIN res ON id = resource_id"),
    "link_status": c.catalogue_sql(c.HASH_CTE, "SELECT id, label, label < 'src2' AS linked FROM res"),
    "queryable_scope": "SELECT DISTINCT source AS label, CASE WHEN source = 'src4' THEN 'notes' ELSE 'docs' END AS kind FROM documents WHERE source <> 'src3'",
    "llms_scope": "WITH " + c._HREFS + r""", s AS (SELECT page_id, regexp_replace(url, '[^/]*$', '') AS folder, unnest(links) AS link FROM l)
SELECT page_id, link, starts_with(link, folder) AND NOT regexp_matches(lower(link), '\.(""" + "|".join(urls.ASSETS) + r""")$') AS in_scope FROM s""",
    "url_spellings": f"WITH {_URL_CTE} " + " UNION ALL ".join(f"SELECT page_id, '{name}' AS spelling, {_sql(want)} AS canonical, {want == '{scheme}://{host}{path}'} AS same_page FROM w" for name, _, want in SPELLINGS),
    "scope_hostile": " UNION ALL ".join(f"SELECT page_id, '{name}' AS link, {inside} AS in_scope, {inside} AS in_llms_scope FROM pages" for name, _, inside in HOSTILE),
    "input_names": " UNION ALL ".join(f"SELECT page_id, replace('{given}', '{{i}}', page_id::VARCHAR) AS given, replace('{label}', '{{i}}', page_id::VARCHAR) AS label FROM pages" for given, label in NAMED),
    "retry_delays": "SELECT event_id, least(10.0, CASE WHEN event_id % 4 = 1 THEN event_id % 30 ELSE 0.5 * 2 ** (event_id % 8) END)::DOUBLE AS seconds FROM events",
    "paper_header": r"""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'v3' WHEN 1 THEN 'v1' END AS version,
  CASE WHEN page_id % 3 = 0 THEN format(E'Research paper\n\nRegistry: arXiv\nID: {0}\nVersion: v3\nTitle: On Sets & Bags {0}\nAuthors: Roe, A, Poe, {0}\nDate: 2024/01/01\n\nAbstract:\nWe count to {0}.', page_id)
       WHEN page_id % 3 = 1 THEN format(E'Research paper\n\nRegistry: arXiv\nID: {0}v1\nVersion: v1\nTitle: T{0}\nPDF: https://arxiv.org/pdf/{0}v1\n\nAbstract:\nA', page_id)
       ELSE format(E'Research paper\n\nRegistry: arXiv\nID: {0}\nTitle: T{0}\nPDF: https://arxiv.org/pdf/{0}v1\n\nAbstract:\nA', page_id) END AS header FROM pages""",
    "embed_passages": "SELECT doc_id, 256 AS dims, 1.0::DOUBLE AS norm, true AS round_trip FROM documents",
    "bench_summary": """WITH b AS (SELECT *, CASE WHEN item_id % 2 = 0 THEN 'small' ELSE 'large' END AS mode,
  CASE WHEN item_id % 3 = 0 THEN 'rrf_hybrid' ELSE 'rrf_hybrid source_prior: llms_txt ' || lower(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')) END AS said FROM benchmark)
SELECT mode, count(*) AS cases, count(*) FILTER (item_id % 7 <> 6 AND len(list_filter(string_split(text, ' '), lambda t: NOT contains(said, lower(t)))) = 0) AS passed,
  count(*) AS hybrid, count(*) FILTER (item_id % 3 <> 0) AS prior, round(avg(item_id), 3) AS mean_s, max(item_id)::DOUBLE AS max_s FROM b GROUP BY mode""",
    "run_status": """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'timeout' WHEN event_id % 5 = 0 THEN 'ok' ELSE ['rate_limited', 'blocked', 'failed', 'blocked'][event_id % 4 + 1] END AS status,
  CASE event_id % 4 WHEN 0 THEN event_id * 7 WHEN 1 THEN event_id * 7 * 1024 END AS max_rss_bytes FROM events""",
    "target_discovery": "SELECT min(page_id) AS page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host FROM pages GROUP BY 2",
    "table_counts": "SELECT count(*) AS rows, count(embedding) AS with_embedding FROM embeddings",
}
