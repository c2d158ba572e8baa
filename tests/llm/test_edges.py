"""Odd tables for every operator and every stage: clashing names, no rows, null and repeated ids, very long texts."""

import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loamline.llm import exact_dedup, importance, jaccard_join, language_id, line_dedup, mixing, packing, quality_classifier, quality_rules, toxicity
from loamline.llm.token_counts import count_tokens

LLM = Path(corpus_pipeline.__file__).parent / "loamline" / "llm"
COLUMNS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}


def internal_names():
    """Every name that the operators' code gives to a column, and every one it might."""
    code = "".join(p.read_text() for p in [*LLM.glob("*.py"), Path(corpus_pipeline.__file__)])
    found = set(re.findall(r"""["']([a-z_]{1,20})["']""", code)) | {f"k{i}" for i in range(8)}
    return sorted(found - set(COLUMNS))


def odd_rows():
    rng = random.Random(9)
    words = [f"{a}{b}en" for a in "bdgkt" for b in "mnrsl"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = text(60)
    texts = [None, "", " \n\t", "12 ½", "x", "X", base, base + " more", base.upper(), "menu\n" + text(20), "menu\n" + text(30), "menu", text(3), "\n".join([text(9)] * 4)]
    rows = [(i, t, ["xx", None][i % 4 == 3], ["a", "b", None][i % 3], 0) for i, t in enumerate(texts)]
    rows += [(6, base, "xx", "a", 0), (6, text(40), "xx", "a", 0), (7, None, None, None, None), (None, base, None, None, None), (None, "x", "xx", "a", 1)]
    return [*rows, (90, text(400_000), "xx", "b", 0)]  # some two million characters


@pytest.fixture(scope="module")
def odd(spark):
    names = internal_names()
    assert {"size", "draws", "lm_id", "rep", "sig", "target", "spans", "tokens", "n_lines"} <= set(names)
    docs = spark.createDataFrame(odd_rows(), ", ".join(f"{k} {v}" for k, v in COLUMNS.items()))
    return docs.select("*", *[F.lit(n).alias(n) for n in names])


OPERATORS = {
    "count_tokens": lambda d: count_tokens(d, keep=("source", "tokens", "lang")),
    "quality": lambda d: quality_classifier.score(d, quality_classifier.train([(b"aden bmen", 1), (b"x y", 0)])),
    "pack": lambda d: packing.pack(d).groupBy("doc_id").agg(F.count("*").alias("n")),
    "toxicity": lambda d: toxicity.score(d, toxicity.train([(b"a b c d e f vile.", 1), (b"a b c d e f.", 0)])),
    "jaccard_join": jaccard_join.jaccard_join,
    "deduplicated": jaccard_join.deduplicated,
    "line_dedup": line_dedup.line_dedup,
    "exact_dedup": exact_dedup.exact_dedup,
    "identify": lambda d: language_id.identify(d, language_id.train([(b"aden bmen", "xx"), (b"eau ation", "yy")] * 4, max_batches=2)),
    "mix": lambda d: mixing.mix(d, carry=d.columns),
    "mixed": lambda d: mixing.mixed(mixing.mix(d, carry=d.columns)),
    "with_counts": quality_rules.with_counts,
    "quality_rules": quality_rules.quality_rules,
    "importance_resample": lambda d: importance.importance_resample(d, d, n=2),
}
ONE_ROW_EACH = ["quality", "toxicity", "jaccard_join", "line_dedup", "exact_dedup", "identify", "mix", "with_counts", "quality_rules", "count_tokens", "importance_resample"]


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_on_odd_rows_and_clashing_names(odd, name):
    out = OPERATORS[name](odd)
    rows = out.collect()
    if name in ONE_ROW_EACH:
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in odd_rows())
    if name == "pack":
        assert {r["doc_id"] for r in rows} == {r[0] for r in odd_rows()}
    if name in ("line_dedup", "identify", "with_counts", "quality_rules", "deduplicated"):
        made = {"line_dedup": {"n_lines", "n_dropped"}, "identify": {"lang_pred", "score", "spans"}, "quality_rules": {"rejected_by"}}.get(name, set())
        made |= {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"} if name == "with_counts" else set()
        assert set(out.columns) == set(odd.columns) | made and all(r[c] == c for r in rows for c in set(internal_names()) - made)


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_on_no_rows(odd, name):
    assert OPERATORS[name](odd.limit(0)).count() == 0


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_on_odd_rows_and_on_none(spark, odd, name, stage):
    out, none = stage(spark, odd, "unused"), stage(spark, odd.limit(0), "unused")
    assert none.count() == 0
    rows = out.collect()
    if stage is corpus_pipeline.STAGES[-1][1]:
        assert {r["doc_id"] for r in rows} == {r[0] for r in odd_rows()}
        return
    assert out.columns == none.columns == odd.columns
    assert all(r[c] == c for r in rows for c in internal_names())
    ids = [r["doc_id"] for r in rows]
    if name == "line dedup":
        assert sorted(map(str, ids)) == sorted(str(r[0]) for r in odd_rows())
    if name == "language ID":
        assert not {0, 1, 2, 3} & set(ids) and {4, 5, 6, 9, 90} <= set(ids)
    if name == "n-gram Jaccard join":
        assert sorted(i for i in ids if i is not None) == [0, 1, 2, 3, 4, 6, 9, 10, 11, 12, 13, 90]


def test_run_on_no_rows(spark, tmp_path):
    spark.createDataFrame([], ", ".join(f"{k} {v}" for k, v in COLUMNS.items())).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("fit", [quality_classifier.fit, toxicity.fit, language_id.fit])
def test_fit_on_nothing_to_learn_from(spark, fit):
    texts = spark.createDataFrame([(1, None), (2, None), (None, "a b"), (3, "a b c")], "id long, text string")
    for labels in ([], [(1, 1), (2, 0)], [(None, 1), (3, None)], [(3, 1), (3, 1)]):
        given = spark.createDataFrame(labels, "id long, label int")
        given = given.withColumn("label", F.col("label").cast("string")) if fit is language_id.fit else given
        assert fit(texts, given) is not None


def test_ids_that_are_text(spark):
    """An id that is no number counts as null where ids are numbers, and stays as it is where they are not."""
    base = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([("a1", base), ("7", base + " x"), ("8", "other"), (None, "y z"), ("1e3", None)], "doc_id string, text string")
    pieces = packing.pack(docs).collect()
    assert sorted(str(r["doc_id"]) for r in pieces if r["start"] == 0) == ["7", "8", "None", "None", "None"]
    joined = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_join(docs).collect()}
    assert {r for r in joined if r[0] is not None} == {(7, 38, 7), (8, 1, 8)}
    assert "8" in {r["doc_id"] for r in jaccard_join.deduplicated(docs).collect()}
    assert {r["doc_id"] for r in exact_dedup.exact_dedup(docs).collect()} == {"a1", "7", "8", None, "1e3"}
    assert {r["doc_id"] for r in line_dedup.line_dedup(docs.withColumn("source", F.lit("s"))).collect()} == {"a1", "7", "8", None, "1e3"}


def test_repeated_id_links_all_its_texts(spark):
    text = lambda k: " ".join(f"{k}{i}" for i in range(50))
    rows = [(1, text("a")), (2, text("b")), (3, text("a")), (3, text("b")), (4, text("c")), (5, text("c") + " end"), (5, text("d")), (6, text("e"))]
    got = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r["doc_id"], r["component_id"]) for r in got.collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6)}


@pytest.mark.parametrize("block, limit", [(4, 100_000), (512, 0), (512, 100_000)])
def test_large_group_of_near_copies_equals_brute_force(spark, block, limit, monkeypatch):
    """One base text, changed in more and more words: many are linked, many are near and not linked."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rng = random.Random(3)
    base, texts = [f"w{i}" for i in range(130)], []
    for _ in range(90):
        words = list(base)
        for _ in range(rng.randrange(9)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(400)}"
        texts.append(" ".join(words))
    sets = [set(zip(*[t.split()[k:] for k in range(5)], strict=False)) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if 100 * len(a & b) >= 80 * len(a | b):
                u, v = find(i), find(j)
                root[max(u, v)] = min(u, v)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = jaccard_join.jaccard_join(docs, words=5, threshold=80, broadcast_rows=limit).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: find(i) for i in range(len(texts))}
    assert 5 < len({find(i) for i in range(len(texts))}) < 80
