import sqlite3
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from loamline.functions import html, markdown, text, url_parser, urls, versions
from loamline.operators import catalog, chunking, crawl, retrieval


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_terms_keep_punctuation_inside_and_first_occurrences(spark):
    assert one(spark, text.tokenize_query(F.lit("What is RLS, rls. and err_x in a/b? ÀB"))) == ["what", "is", "rls", "rls.", "and", "err_x", "in", "a/b", "Àb"]


def test_index_tokens_fold_marks_and_split_underscores(spark):
    assert one(spark, text.index_tokens(F.lit("CAFÉ err_module -- x9"))) == ["cafe", "err", "module", "x9"]


@pytest.mark.parametrize(
    "url, kind, paper",
    [
        ("https://github.com/o/r", "source", ""),
        ("https://github.com/o", None, ""),
        ("https://arxiv.org/pdf/2401.00001v2.pdf", "research_paper", "2401.00001v2"),
        ("https://example.com/docs", "docs", ""),
        ("file:///tmp/a.md", "notes", ""),
        ("notes.md", None, ""),
    ],
)
def test_inputs(spark, url, kind, paper):
    assert one(spark, urls.input_kind(F.lit(url))) == kind
    assert one(spark, urls.arxiv_id(F.lit(url))) == paper


@pytest.mark.parametrize(
    "seed, candidate, inside",
    [
        ("https://e.com/docs", "https://e.com/docs/a", True),
        ("https://e.com/docs", "https://e.com/docsx", False),
        ("https://e.com/docs", "https://e.com:443/docs/a", True),
        ("https://e.com/docs", "https://other.com/docs/a", False),
        ("https://e.com/docs", "https://e.com/docs/a.PNG", False),
    ],
)
def test_scope(spark, seed, candidate, inside):
    assert one(spark, urls.in_scope(F.lit(seed), F.lit(candidate))) is inside


def test_chunks_pack_greedily_by_bytes_and_keep_long_paragraphs(spark):
    a, b, c = "é" * 600, "b" * 1194, "c" * 5000
    assert one(spark, chunking.pack_paragraphs(F.lit(f"{a}\n\n \n\n{b}\n\nx\n\n{c}"))) == [f"{a}\n\n{b}", "x", c]
    assert one(spark, chunking.pack_paragraphs(F.lit(" \n\n "))) == []


def test_sections_follow_headings_but_not_fences():
    got = markdown.sections("intro\n\n# A\r\n\n```\n# no\n```\n\n### B\n\nSetext\n---\ntext\n# A")
    assert [(s["level"], s["heading_path"], s["parent"], s["anchor"]) for s in got] == [
        (0, [], None, None), (1, ["A"], None, "a"), (3, ["A", "B"], 1, "b"), (2, ["A", "Setext"], 1, "setext"), (1, ["A"], None, "a-2"),
    ]
    assert got[0]["next"] == 1 and got[-1]["next"] is None


def test_prior_lifts_rank_nine_over_rank_one_but_not_rank_ten():
    lifted = lambda r: 1 / (retrieval.RRF_K + r) + retrieval.PRIOR > 1 / (retrieval.RRF_K + 1)
    assert lifted(9) and not lifted(10)


def test_cosine_cuts_to_the_shorter_and_takes_zero_norms(spark):
    a, b, z = (F.array(*[F.lit(float(x)) for x in v]) for v in ((3, 4, 9), (3, 4), (0, 0)))
    assert one(spark, retrieval.cosine(a, b)) == pytest.approx(1.0)
    assert one(spark, retrieval.cosine(b, z)) == 0.0


def test_crawl_survives_cycles_and_drops_what_the_cap_cuts(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "url string")
    edges = spark.createDataFrame([("a", "c"), ("a", "b"), ("b", "a"), ("c", "d"), ("a", "gone")], "src string, dst string")
    seed = spark.createDataFrame([("a",)], "url string")
    assert [r["url"] for r in crawl.bounded_bfs(nodes, edges, seed, 10).orderBy("page_order").collect()] == ["a", "b", "c", "d"]
    assert [r["url"] for r in crawl.bounded_bfs(nodes, edges, seed, 2).orderBy("page_order").collect()] == ["a", "b"]


def test_upsert_keeps_the_latest(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "id int, v string, at int")
    new = spark.createDataFrame([(1, "A", 1), (2, "B", 4), (3, "C", 1)], "id int, v string, at int")
    assert {r["id"]: r["v"] for r in catalog.upsert(old, new, ["id"], "at").collect()} == {1: "A", 2: "b", 3: "C"}


def test_body_of_pages_without_body_tags(spark):
    pages = {
        "<h2>Title</h2><p>x</p>": "Title\nx\n",
        "<html><head><title>t</title><style>a{}</style></head><h2>A</h2><span>b</span>": "A\nb\n",
        "<head><script>no()</script></head><body>one<script>two()</script></body>": "one\ntwo()\n",
        "<title>only</title>": "<title>only</title>",
        "plain &amp; simple": "plain & simple\n",
    }
    rows = spark.createDataFrame(list(pages.items()), "html string, want string")
    assert rows.filter(html.html_to_text(F.col("html")) != F.col("want")).count() == 0


def test_fold_equals_the_full_text_index(spark):
    """Over letters up to U+0527 and the Latin ones beyond, what SQLite's own tokenizer gives; U+037F is younger than it."""
    db = sqlite3.connect(":memory:")
    try:
        db.execute("CREATE VIRTUAL TABLE t USING fts5(x)")
    except sqlite3.OperationalError:
        pytest.skip("no full-text index here")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    letters = [chr(c) for c in (*range(0xC0, 0x528), *range(0x1E00, 0x1F00)) if c != 0x37F and unicodedata.category(chr(c))[0] in "LNM"]
    db.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", [(i, f"a{x}b") for i, x in enumerate(letters)])
    want = {i: [] for i in range(len(letters))}
    for term, doc in db.execute("SELECT term, doc FROM v ORDER BY doc, offset"):
        want[doc].append(term)
    rows = spark.createDataFrame([(i, f"a{x}b") for i, x in enumerate(letters)], "i int, x string").select("i", text.index_tokens(F.col("x")).alias("t")).collect()
    assert [(letters[r["i"]], r["t"], want[r["i"]]) for r in rows if r["t"] != want[r["i"]]] == []


def test_version_order_edges(spark):
    rows = [("1.2.3", "1.2.3", "same"), ("1.9.0", "1.10.0", "older"), ("2.0.0-rc1", "1.9.9", "newer"), ("1.2", "1.2.0", "unknown"), ("1..2", "1.0.0", "unknown"), ("1.0.0\n", "1.0.0", "unknown"), ("", "1.0.0", "unknown"), (None, "1.0.0", "unknown"), ("18446744073709551615.0.0", "1.0.0", "newer"), ("1.0.0+b-c", "1.0.0", "same")]
    got = spark.createDataFrame(rows, "a string, b string, want string").withColumn("got", versions.version_order(F.col("a"), F.col("b"))).collect()
    assert [(r["a"], r["got"]) for r in got if r["got"] != r["want"]] == []


def test_semantic_versions(spark):
    rows = [("1.2.3", True), ("0.0.0", True), ("1.2.3-rc.1+b-2.x", True), ("1.2.3+b", True), ("01.2.3", False), ("1.2", False), ("1.2.3.4", False), ("1.2.3-", False), ("1.2.3+a..b", False), ("1.2.3\n", False), ("v1.2.3", False), (None, None)]
    got = spark.createDataFrame(rows, "v string, want boolean").select("v", "want", versions.well_formed(F.col("v")).alias("got")).collect()
    assert [(r["v"], r["got"]) for r in got if r["got"] != r["want"]] == []


@pytest.mark.parametrize(
    "text, base, want",
    [
        ("../b", "https://h/x/y/z?q", "https://h/x/b"),
        ("?k", "https://h/x/y#f", "https://h/x/y"),
        ("//o/p", "https://h/x", "https://o/p"),
        ("http:rel", "http://h/a/b", "http://h/a/rel"),
        ("https:rel", "http://h/a/b", "https://rel/"),
        ("..", "https://h/a/b/c", "https://h/a/"),
        ("a/%2e%2E/b/.%2e/c/%2e", "https://h/x/", "https://h/x/c/"),
        ("x", "mailto:q", None),
        ("mailto:a@b?x", None, "mailto:a@b"),
        ("file:///tmp/../a.md", None, "file:///a.md"),
        ("http://256.1.1.1/", None, None),
        ("http://1.2.3.4.5/", None, None),
        ("http://[::1]:80/", None, "http://[::1]/"),
        ("http://a%2fb/", None, None),
        ("http://h:99999/", None, None),
        ("http://@h/", None, "http://h/"),
        ("x:/a/./b", None, "x:/a/b"),
        ("notes.md", None, None),
        ("", "https://h/x?y", "https://h/x"),
    ],
)
def test_urls_by_the_standard(text, base, want):
    assert url_parser.absolute(text, base) == want


@pytest.mark.parametrize(
    "source, want",
    [
        ("a\\\nb", "a b"), ("[b](u(v)w)", "b"), ("> quote\nlazy\n===", "quote lazy ==="), ("[a]: http://x", ""), ("# A\n1) one\n   - two\n     # deep", "A one two deep"),
        ("***a** b*", "a b"), ("2*3", "2 * 3"), ("*a [b*](u)", "* a b *"), ("[a [b](u) c](v)", "[ a b c ] (v)"), ("a`` b ` c ``d", "a b ` c d"), ("x ~~~~c ~a~", "x ~~~~c a"), ("- [ ] task\n- [x] done", "task done"),
        (">     code\n> x", "code x"), ("-\ttab\n\n\tpara", "tab para"), ("text\n2. no list", "text 2. no list"), ("foo\n<b>bar", "foo bar"), ("<!-- c\n\n c2 -->\nx", "x"), ("# a # b #", "a # b"), ("-\n\n  foo", "foo"),
    ],
)
def test_plain_text_of_markdown(source, want):
    assert markdown.plain_text(source) == want


@pytest.mark.parametrize(
    "source", ["*a " * 20_000, "[" * 20_000, "[a](b" * 8000, ">" * 3000 + "x", "*a _b " * 8000, "_a*" * 10_000, "<div>" * 20_000, '<a x="1" ' * 5000, "<!--" * 20_000, "<table>" * 3000]
)
def test_hostile_sources_take_no_long_time(source):
    began = time.perf_counter()
    markdown.plain_text(source), html.text_of(source), html.links_of(source)
    assert time.perf_counter() - began < 20
