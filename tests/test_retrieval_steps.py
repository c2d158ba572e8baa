"""The steps that all retrieval queries share: their results, and that they pass over a chunk's tokens once."""

import math
import os
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from loamline.functions import phrases, text
from loamline.operators import checkpoints, chunking, retrieval
from loamline.plans import catalogue, lifecycle

TEXTS = ["", " ", "a", "\u3000 a  b\t\u00a0", "x\n\ny  z \r\n", "\u2028\u1680a\u200ab\u205f", "Caf\u00e9 \u03a3\u03a3  \u03b1\u03a3\n\u0301e", "\x1c a \x1f", "one two", "  lone  spaces are kept "]


def test_trim_and_compact_equal_the_patterns(spark):
    x = F.col("x")
    rows = spark.createDataFrame([(t,) for t in TEXTS] + [(None,)], "x string")
    plain = (F.regexp_replace(x, r"(?U)^\s+|\s+$", ""), F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))
    for r in rows.select(F.array(text.unicode_trim(x), text.compact_whitespace(x)).alias("got"), F.array(*plain).alias("want")).collect():
        assert r["got"] == r["want"]


def test_spaces_are_those_of_the_patterns(spark):
    every = spark.createDataFrame([(chr(i),) for i in range(1, 0xD800)], "x string").filter(F.col("x").rlike(r"(?U)\s")).collect()
    assert "".join(r["x"] for r in every) == text.SPACES


def test_search_tokens_equal_those_of_the_search_content(spark):
    rows = spark.createDataFrame([("La\u03a3 ", "http://h/\u00c9", t) for t in TEXTS] + [(None, "u", "x"), ("l", None, "y")], "label string, url string, content string")
    rows = rows.withColumn("plain", text.compact_whitespace("content"))
    parts = [F.col("label"), F.col("url"), F.array().cast("array<string>"), F.col("plain"), F.col("content")]
    want = text.index_tokens(chunking.search_content(*parts))
    for packed in (True, False):
        for r in rows.select(chunking.search_tokens(*parts, F.lit(packed)).alias("got"), want.alias("want")).collect():
            assert r["got"] == r["want"]


def test_phrases_are_counted_in_one_pass(spark):
    tokens = [("a", ["by", "nc", "by", "nc", "x"]), ("b", ["x", "x", "x"]), ("c", ["nc", "by"]), ("d", []), ("e", None), ("f", ["x", "by", "nc"])]
    phrases = [["x"], ["by", "nc"], ["x", "x"], ["by"], ["nc"], ["none"]]
    got = retrieval.phrase_counts(spark.createDataFrame(tokens, "chunk_key string, tokens array<string>"), phrases)
    want = Counter()
    for key, t in tokens:
        for p in phrases:
            n = sum(1 for i in range(len(t or [])) if t[i : i + len(p)] == p)
            want.update([(key, len(t), " ".join(p), n)] if n else [])
    assert Counter(map(tuple, got.collect())) == want
    words = retrieval.phrase_counts(spark.createDataFrame(tokens, "chunk_key string, tokens array<string>"), [[f"w{i}"] for i in range(13)])
    plan = words._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("filter(tokens#") == 1  # not one pass for each phrase


def test_phrases_are_counted_over_head_and_repeated_tokens(spark):
    rows = [("a", ["x", "by"], ["nc", "x", "by"]), ("b", [], ["nc", "by"]), ("c", ["by"], []), ("d", ["q"], ["x"]), ("e", ["q"], ["q"])]
    phrases = [["x"], ["by", "nc"], ["x", "x"], ["by"], ["x", "x", "x"]]
    got = retrieval.phrase_frequencies(spark.createDataFrame(rows, "k string, head array<string>, tokens array<string>"), phrases, "head", 2)
    assert got.columns == ["k", "d", "tf"]
    whole = {k: h + t + t for k, h, t in rows}
    want = {k: (len(w), [sum(w[i : i + len(p)] == p for i in range(len(w))) for p in phrases]) for k, w in whole.items()}
    assert {r["k"]: (r["d"], r["tf"]) for r in got.collect()} == want


def test_counts_of_texts_equal_those_of_their_tokens(spark):
    odd = ["by-nc", "BY NC by", "by \u00c9t\u00e9 ETE ete", "\u00b5 \u03bc \u039c", "x\u00b2 \u00bd\u00aa x2", "\u00df ss", "\u0130 i\u0307 i", "by\u2019nc", "\u4e2d by nc", "b\x00y nc", "by\x85nc\xa0by\xadnc", "e\u0301te", "\U0001d44f by nc"]
    rows = [(i, h, t) for h in ("src1\nhttp://h/by\n", "", None, "\u03a3 x") for i, t in enumerate([*TEXTS, *odd, "".join(map(chr, range(1, 256))), " ".join(map(chr, range(1, 256))), None])]
    rows += [(1000 + i, "h", "nc x by " * (i % 7)) for i in range(300)]
    given = spark.createDataFrame(rows, "k int, head string, text string").repartition(3)
    broken = given.selectExpr("k", "head", "cast(concat(cast(text as binary), X'C320', cast(' by nc' as binary)) as string) AS text")
    phrases = [["by"], ["by", "nc"], ["x"], ["ete"], ["\u03bc"], ["i"], ["\u4e2d"], ["x\u00b2"], ["\u00bd\u00aa"], ["x", "by", "nc"], ["none"], ["by", "by"]]
    for table in (given, broken):
        for some in (phrases, []):
            tokens = table.select("k", text.index_tokens(F.col("head")).alias("head"), text.index_tokens(F.col("text")).alias("tokens"))
            want = retrieval.phrase_frequencies(tokens, some, "head", 2)
            got = retrieval.text_frequencies(table, some, "head", "text", 2)
            assert got.dtypes == want.dtypes
            assert Counter((r["k"], r["d"], tuple(r["tf"])) for r in got.collect()) == Counter((r["k"], r["d"], tuple(r["tf"])) for r in want.collect())


def test_texts_of_latin_are_counted_without_tokens():
    texts = pa.array(["The \u00e9t\u00e9", None, "\u4e2d the", "the the"])
    got = phrases.frequencies(pa.array(["h"] * 4), texts, [["the"], ["the", "the"]], 2).to_pylist()
    assert got == [{"d": 5, "tf": [2, 0]}, None, None, {"d": 5, "tf": [4, 3]}]


def test_letters_are_those_of_the_index(spark):
    rows = spark.createDataFrame([(i, chr(i)) for i in range(1, 256)], "i int, x string").select("i", text.index_tokens(F.col("x")).alias("t")).collect()
    table, codes = phrases.letters()
    back = {i: x for x, i in codes.items()}
    assert {r["i"]: r["t"] for r in rows} == {i: [back[table[i]]] if table[i] else [] for i in range(1, 256)}


def test_scores_of_chunks_equal_the_formula_and_need_a_phrase(spark):
    rows = [("a", ["x", "y"]), ("b", ["x", "x", "z", "z"]), ("c", ["z"]), ("d", [])]
    frame = spark.createDataFrame(rows, "chunk_key string, tokens array<string>")
    got = {r["chunk_key"]: r["score"] for r in retrieval.bm25_of(frame, [["x"], ["y"], ["none"]]).collect()}
    mean, idf = 7 / 4, {"x": retrieval.LEAST_IDF, "y": math.log(3.5 / 1.5)}
    part = lambda w, tf, d: idf[w] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * d / mean))
    assert got == {"a": round(part("x", 1, 2) + part("y", 1, 2), 6), "b": round(part("x", 2, 4), 6)}
    assert retrieval.bm25_of(frame, []).count() == 0
    assert retrieval.bm25_of(frame.limit(0), [["x"]]).count() == 0


def test_pages_numbered_by_counts_equal_pages_numbered_whole(spark):
    p = "p" * 1500
    rows = [("r", "s", "l", i, f"u{i}", [None, "", p, f"{p}\n\n{p}\n\n{p}", "short"][i % 5]) for i in (*range(12), 5000, 9001)]
    rows += [("q", "s", "l", 3, "v", f"{p}\n\n{p}")]
    pages = spark.createDataFrame(rows, "resource_id string, snapshot_id string, label string, page_index long, url string, content string")
    shown = ["chunk_key", "chunk_index", "url", "page_chunk", "content", "plain_text"]
    want = sorted(tuple(r) for r in chunking.chunk_pages(pages).select(shown).collect())
    cut = chunking.cut_pages(pages)
    first = chunking.first_chunks(cut, "page_index")
    some = pages.join(first, ["resource_id", "snapshot_id", "page_index"])
    assert sorted(tuple(r) for r in chunking.chunk_pages(some, "first_chunk").select(shown).collect()) == want
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("size(")  # counted below: no chunk carries the others of its page


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
@pytest.mark.parametrize("query", [catalogue.bm25_topk, catalogue.scope_pre_limit, catalogue.bm25_stats, lifecycle.evidence_items])
def test_no_text_or_tokens_of_the_corpus_are_written(spark, monkeypatch, query):
    """But the chunks of documents with a candidate, which bring the number of their first chunk."""
    written = []

    def stored(df):
        written.append((set(df.columns), "first_chunk" in df._jdf.queryExecution().analyzed().toString()))
        return checkpoints_stored(df)

    checkpoints_stored = checkpoints.stored
    for module in (checkpoints, chunking, retrieval, catalogue):
        monkeypatch.setattr(module, "stored", stored)
    query(spark, "/root/testdata/sf0.001").collect()
    assert written
    assert not [c for c, few in written if "tokens" in c or ("content" in c or "lm_chunks" in c) and not few]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_an_index_of_the_corpus_takes_little_disk(spark):
    """Neither texts nor tokens are written, and no block as Spark's rows have it."""
    at = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(at) for f in files)
    before = size()
    assert catalogue.bm25_postings(spark, "/root/testdata/sf0.01").count() == 500
    assert 0 < size() - before < 4 * os.path.getsize("/root/testdata/sf0.01/documents.parquet")


@pytest.mark.parametrize("limit", [0, 100])
def test_numbers_come_to_the_texts(spark, limit):
    """Up to a limit of rows; beyond, by a join that shuffles."""
    ids = [None, -3, 0, 5, 255, 256, 1000, 7 << 40]
    pages = spark.createDataFrame([(i, f"t{i}") for i in [*ids, 6, 257]], "doc_id long, content string")
    first = spark.createDataFrame([("r", "s", i, 10 * n) for n, i in enumerate(ids)], "resource_id string, snapshot_id string, doc_id long, first_chunk long")
    got = chunking.with_first(pages, first, "doc_id", limit)
    assert sorted(tuple(r) for r in got.select("doc_id", "content", "first_chunk").collect()) == sorted((i, f"t{i}", 10 * n) for n, i in enumerate(ids) if i is not None)
    assert ("broadcast" in got._jdf.queryExecution().analyzed().toString().lower()) == (limit == 100)


@pytest.mark.parametrize("limit", [0, 5])
def test_few_rows_are_marked_for_broadcast_and_more_are_not(spark, limit):
    few = checkpoints.stored_few(spark.range(3).select(F.col("id").alias("k")), limit)
    joined = spark.range(10).select(F.col("id").alias("k")).join(few, "k", "left")
    assert ("broadcast" in joined._jdf.queryExecution().analyzed().toString().lower()) == (limit == 5)
    assert joined.count() == 10


def test_a_file_of_one_row_group_is_read_into_all_cores(spark, tmp_path):
    """Cut into as many parts as there are cores, of which all but one are empty."""
    n = 200_000
    pq.write_table(pa.table({"k": range(n), "x": [f"{i * 7919:030d}" for i in range(n)]}), tmp_path / "one.parquet", compression="none")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        table = spark.read.parquet(str(tmp_path / "one.parquet"))
        assert table.rdd.getNumPartitions() >= 4
        sizes = lambda df: [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
        assert sizes(table) == [n]
        even = sizes(checkpoints.spread(table, "k"))
        assert sum(even) == n and len(even) >= 4 and max(even) < n / 3
        assert checkpoints.spread(table.filter("k < 0"), "k").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    good = spark.range(0, 100, 1, 6)
    assert checkpoints.spread(good, "id") is good  # what is even stays where it is


@pytest.mark.parametrize("numbered", [chunking.cut_pages, lambda pages: chunking.chunk_pages(pages, "first")])
def test_each_text_is_cut_once(spark, numbered):
    """Not again to ask, before all else, whether it has chunks."""
    pages = spark.createDataFrame([("r", "s", 0, "a")], "resource_id string, snapshot_id string, first int, content string")
    plan = numbered(pages)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1


PAGES = [
    "", "\n\n", " \n\n\n\n\t", None, "by nc", "by\n\nnc", "\n\n\nby\n\n\n nc \u2003\n\n\x1cx\x1c", "\u00e9t\u00e9 " * 500 + "\n\nby nc\n\n" + "\u00e9" * 1200 + "\n\nx", "x" * 2398 + "\n\ny", "x" * 2397 + "\n\n",
    "x" * 2395 + "\n\ny", "x" * 2394 + "\n\ny", "by " * 3000 + "\n\nnc", "\n\n".join(f"by nc {i}" * 9 for i in range(200)), "by nc\n\n" + "\u4e2d " * 900 + "\n\nby nc", "\u4e2d\n\nby", "\xa0\n\n\x85by\x85\n\nnc",
]


def test_texts_are_cut_by_workers_as_by_spark(spark):
    given = spark.createDataFrame([(i, t) for i, t in enumerate(PAGES)], "i int, t string")
    want = {r["i"]: r["c"] for r in given.select("i", chunking.pack_paragraphs(F.col("t")).alias("c")).collect()}
    assert {i: None if t is None else chunking.packed_texts(t) for i, t in enumerate(PAGES)} == want


def test_chunks_of_workers_equal_those_of_spark(spark):
    given = spark.createDataFrame([(t,) for t in PAGES], "t string")
    broken = given.withColumn("t", F.expr("cast(concat(cast(t as binary), X'C320', cast(' by nc' as binary)) as string)"))
    for table in (given, broken, given.limit(0)):
        rows = table.select(chunking.worker_chunks(F.col("t")).alias("got"), chunking.pack_paragraphs(F.col("t")).alias("want"))
        assert rows.filter(~F.col("got").eqNullSafe(F.col("want"))).count() == 0


def test_counts_of_whole_pages_equal_those_of_their_chunks(spark):
    rows = [(i, h, t) for i, t in enumerate(PAGES) for h in ("src1\nhttp://h/by\n", None, "\u4e2d by")] + [(1000 + i, "h", f"x by nc {i}\n\n" * (i % 150)) for i in range(300)]
    given = spark.createDataFrame(rows, "k int, head string, content string").repartition(3)
    broken = given.selectExpr("k", "head", "cast(concat(cast(content as binary), X'C320', cast(' by nc' as binary)) as string) AS content")
    for table in (given, broken, given.limit(0)):
        for some in ([["by"], ["by", "nc"], ["nc", "x"], ["\u4e2d"], ["\u00e9t\u00e9"], ["ete"]], []):
            want = retrieval.text_frequencies(chunking.cut_pages(table), some, "head", "content", 2)
            got = retrieval.page_frequencies(table, some, "head", 2)
            assert sorted(got.dtypes) == sorted(want.dtypes)
            seen = lambda df: Counter((r["k"], r["page_chunks"], r["page_chunk"], r["d"], tuple(r["tf"])) for r in df.collect())
            assert seen(got) == seen(want)


def test_workers_hold_texts_by_bytes():
    sizes = [10, phrases.PART_BYTES * 3, 0, phrases.PART_BYTES // 2, phrases.PART_BYTES // 2, None, 7]
    texts = pa.array([None if n is None else "x" * n for n in [*sizes, *[1] * 5000]])
    got = list(phrases.parts(texts))
    assert [i for at, n in got for i in range(at, at + n)] == list(range(len(texts)))
    assert got[0] == (0, 2) and all(sum(len(t or "") for t in texts.slice(at, n - 1).to_pylist()) < phrases.PART_BYTES for at, n in got)
    assert not list(phrases.parts(texts.slice(0, 0))) and list(phrases.parts(texts.slice(4, 3))) == [(0, 3)]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_texts_go_to_workers_whole(spark, monkeypatch):
    """Their chunks are made there, and counted at once: Spark deals out counts."""
    monkeypatch.setattr(catalogue, "stored", lambda df: df)
    plan = catalogue.corpus_counts(spark, "/root/testdata/sf0.001", [["by"]])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("ArrowEvalPython")
