"""Hybrid retrieval: BM25 and cosine candidates, rank fusion, anchors, context, budget, evidence.

Scores are rounded to six digits before they order anything, and ties go to the smaller key, so results do not depend
on partitioning. Wide columns join again only after the candidate limit.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import phrases as phrase_search
from ..functions.text import ascii_lower, index_tokens, token_estimate, tokenize_query
from ..functions.urls import is_llms_txt
from .checkpoints import stored
from .chunking import cut_pages, pack_paragraphs, packed_texts
from .inverted import K1, LEAST_IDF, B, bm25_top

#: Fixed values of the retrieval contract.
TOP_K, BUDGET, RRF_K, PRIOR, ANCHORS, CONTEXT = 5, 20_000, 60, 0.002, 3, 2


def candidate_limit(top_k: int) -> int:
    return max(top_k, 50) * 10


def phrases_of(terms: list[str], spark) -> list[list[str]]:
    """The index phrases of a question's terms; terms without a letter or digit give none."""
    rows = spark.createDataFrame([(t,) for t in terms], "t string").select(index_tokens(F.col("t")).alias("p")).collect() if terms else []
    return _distinct([r["p"] for r in rows])


def _distinct(phrases: list[list[str]]) -> list[list[str]]:
    return [list(p) for p in dict.fromkeys(map(tuple, phrases)) if p]


def read_question(question: str, spark) -> tuple[list[str], list[list[str]]]:
    """A question's terms and index phrases; one evaluation of a row that the planner holds."""
    terms = spark.createDataFrame([(question,)], "q string").select(tokenize_query(F.col("q")).alias("t"))
    got = terms.select("t", F.transform("t", index_tokens).alias("p")).first()
    return list(got["t"]), _distinct(got["p"])


def phrase_frequencies(rows: DataFrame, phrases: list[list[str]], head: str | None = None, times: int = 1) -> DataFrame:
    """rows with d, the number of tokens, and tf, how often each phrase is among them, in the place of tokens.

    head: a column of tokens that come before; times: how often tokens come after each other (a packed chunk is searched
    by its text twice). One pass over each row's tokens keeps the few that are a phrase's word; a longer phrase is looked
    for only in rows that have all its words, where the repetition is written out, as it may begin in one and end in the next.
    """
    kept = [c for c in rows.columns if c not in ("tokens", head)]
    words = sorted({w for p in phrases for w in p})
    empty = F.array().cast("array<string>")
    few = lambda a: F.filter(a, lambda x: x.isin(words)) if words else empty
    before = F.col(head) if head else empty
    d = (F.size(head) if head else F.lit(0)) + times * F.size("tokens")
    once = rows.select(*kept, d.alias("d"), "tokens", before.alias("lm_head"), few("tokens").alias("lm_few"), (few(head) if head else empty).alias("lm_front"))
    several = [p for p in phrases if len(p) > 1]
    there = lambda p: reduce(lambda x, y: x & y, [F.array_contains("lm_few", w) | F.array_contains("lm_front", w) for w in dict.fromkeys(p)])
    if several:
        whole = F.concat("lm_head", F.flatten(F.array_repeat("tokens", times))) if head or times > 1 else F.col("tokens")
        once = once.withColumn("lm_whole", F.when(reduce(lambda x, y: x | y, map(there, several)), whole))

    def count(phrase: list[str]) -> Column:
        if len(phrase) == 1:
            n = lambda a: F.size(a) - F.size(F.array_remove(a, phrase[0]))
            return F.coalesce(n("lm_front") + times * n("lm_few"), F.lit(0))
        later = lambda x, i: [(F.get("lm_whole", i + j) == w) for j, w in enumerate(phrase[1:], 1)]
        found = F.size(F.filter("lm_whole", lambda x, i: reduce(lambda p, q: p & q, later(x, i), x == phrase[0])))
        return F.when(there(phrase), found).otherwise(0)

    return once.select(*kept, "d", F.array(*map(count, phrases)).cast("array<int>").alias("tf"))


def text_frequencies(rows: DataFrame, phrases: list[list[str]], head: str, content: str, times: int = 1) -> DataFrame:
    """phrase_frequencies of the index tokens of two columns of text, in their place.

    Texts of common letters are counted as they are; tokens are made of the others alone.
    """
    kept = [c for c in rows.columns if c not in (head, content)]
    counted = rows.withColumn("lm_counts", phrase_search.phrase_counts(F.col(head), F.col(content), phrases, times))
    return _with_others(counted, kept, phrases, head, content, times)


def _with_others(counted: DataFrame, kept: list[str], phrases: list[list[str]], head: str, content: str, times: int) -> DataFrame:
    """kept, d and tf of counted: its lm_counts, or where that is null the counts of head and content."""
    rest = lambda c: F.when(F.col("lm_counts").isNull(), index_tokens(F.col(c)))
    others = counted.select(*kept, "lm_counts", rest(head).alias("lm_first_tokens"), rest(content).alias("tokens"))
    both = phrase_frequencies(others, phrases, "lm_first_tokens", times)
    return both.select(*kept, *[F.coalesce(f"lm_counts.{c}", c).alias(c) for c in ("d", "tf")])


def page_frequencies(pages: DataFrame, phrases: list[list[str]], head: str, times: int = 1) -> DataFrame:
    """text_frequencies of head and each packed chunk of content, with page_chunks and page_chunk (see chunking.cut_pages).

    Whole texts go to the workers, which cut and count at once; chunks of uncommon letters alone come back as texts. What is no
    UTF-8 is cut here.
    """
    kept = [c for c in pages.columns if c not in (head, "content")]
    found = pages.withColumn("lm_found", phrase_search.chunk_counts(F.col(head), F.col("content"), phrases, times, packed_texts))
    none = F.lit(None).cast(phrase_search.COUNTS).alias("counts")
    left = F.transform(pack_paragraphs(F.when(F.col("lm_found").isNull(), F.col("content"))), lambda t: F.struct(none, t.alias("text")))
    cut = cut_pages(found.select(*kept, head, F.coalesce("lm_found", left).alias("content")), F.col("content"))
    counted = cut.select(*[c for c in cut.columns if c != "content"], F.col("content.counts").alias("lm_counts"), F.col("content.text").alias("content"))
    return _with_others(counted, [*kept, "page_chunks", "page_chunk"], phrases, head, "content", times)


def phrase_counts(tokens: DataFrame, phrases: list[list[str]]) -> DataFrame:
    """chunk_key, d, phrase and tf of every chunk (chunk_key, tokens) with a phrase."""
    rows = phrase_frequencies(tokens.select("chunk_key", "tokens"), phrases)
    every = F.array(*[F.struct(F.lit(" ".join(p)).alias("phrase"), F.get("tf", F.lit(i)).alias("tf")) for i, p in enumerate(phrases)])
    return rows.select("chunk_key", "d", F.inline(F.filter(every, lambda c: c.tf > 0)))


def bm25_scores(counted: DataFrame, phrases: list[list[str]]) -> DataFrame:
    """The rows of counted (d and tf, of every chunk of the index) that have a phrase, with their score for d and tf.

    Frequencies and the mean length are one row; with it each chunk is scored where it is.
    """
    kept = [c for c in counted.columns if c not in ("d", "tf")]
    if not phrases:
        return counted.select(*kept, F.lit(0.0).alias("score")).limit(0)
    tf = [F.get("tf", F.lit(i)) for i in range(len(phrases))]
    stats = counted.agg(F.count("*").alias("n"), F.avg("d").alias("avgdl"), *[F.count_if(t > 0).alias(f"df{i}") for i, t in enumerate(tf)])
    raw = [F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)) for i in range(len(tf))]
    weights = stats.select("avgdl", *[F.when(r > 0, r).otherwise(LEAST_IDF).alias(f"idf{i}") for i, r in enumerate(raw)])
    long = K1 * (1 - B + B * F.col("d") / F.col("avgdl"))
    parts = [F.col(f"idf{i}") * t * (K1 + 1) / (t + long) for i, t in enumerate(tf)]
    found = counted.filter(F.exists("tf", lambda t: t > 0)).join(F.broadcast(weights))  # weights: one row
    return found.select(*kept, F.round(reduce(lambda x, y: x + y, parts), 6).alias("score"))


def bm25_of(tokens: DataFrame, phrases: list[list[str]]) -> DataFrame:
    """The columns of tokens but itself, and score, of every chunk with a phrase, over chunks that have no stored index.

    The counts are written once; frequencies and scores both come from them.
    """
    return bm25_scores(stored(phrase_frequencies(tokens, phrases)), phrases)


def lexical_hits(blocks: DataFrame, n: int, tokens: int, phrases: list[list[str]], limit: int, allowed: DataFrame | None = None) -> pa.Table:
    """resource_id, snapshot_id, chunk_key and score of the limit best chunks of a stored index, the best first."""
    best = bm25_top(blocks, n, tokens, phrases, limit, allowed).best
    keys = [f"{r}:{s}:{i:010d}" for r, s, i in zip(*(best.column(c).to_pylist() for c in ("resource_id", "snapshot_id", "chunk_index")), strict=True)]
    found = best.append_column("chunk_key", pa.array(keys, pa.string())).select(["resource_id", "snapshot_id", "chunk_key", "score"])
    return found.sort_by([("score", "descending"), ("chunk_key", "ascending")])


def numbered(rows: pa.Table, name: str) -> pa.Table:
    """rows, bounded by a limit, with their number from 1 on."""
    return rows.append_column(name, pa.array(range(1, rows.num_rows + 1), pa.int32()))


def among(column: str, values: list[str]) -> Column:
    """Whether a column has one of some hundred values at most; in the text of one expression, which is built at once."""
    quoted = lambda v: "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return F.expr(f"`{column}` IN ({', '.join(map(quoted, values))})") if values else F.lit(False)


def top(scored: DataFrame, limit: int, rank: str) -> DataFrame:
    """The best rows with their rank; the window sees no more than limit rows."""
    best = scored.orderBy(F.desc("score"), "chunk_key").limit(limit)
    return best.withColumn(rank, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "chunk_key")))


def cosine(a: Column, b: Column) -> Column:
    """Exact cosine in double precision over the shorter length; 0 for a zero norm."""
    n = F.least(F.size(a), F.size(b))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    x, y = F.slice(a, 1, n), F.slice(b, 1, n)
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.transform(F.array(norm), lambda m: F.when(m == 0, F.lit(0.0)).otherwise(dot(x, y) / m))[0]  # so norms are worked out once


def cosine_scores(vectors: DataFrame, query: list[float]) -> DataFrame:
    q = F.array(*[F.lit(float(v)) for v in query])
    keys = [c for c in ("resource_id", "snapshot_id", "chunk_key") if c in vectors.columns]
    return vectors.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).select(*keys, F.round(cosine(F.col("embedding"), q), 6).alias("score"))


def fuse(lexical: DataFrame, vector: DataFrame | None) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists, or of the first alone."""
    a = lexical.select("chunk_key", "lexical_rank", F.col("score").alias("lexical_score"))
    part = lambda r: F.coalesce(1 / (RRF_K + F.col(r)), F.lit(0.0))
    if vector is None:
        both = a.withColumn("vector_rank", F.lit(None).cast("int")).withColumn("vector_score", F.lit(None).cast("double"))
    else:
        both = a.join(vector.select("chunk_key", "vector_rank", F.col("score").alias("vector_score")), "chunk_key", "full_outer")
    return both.withColumn("rrf", part("lexical_rank") + part("vector_rank"))


def with_prior(fused: DataFrame) -> DataFrame:
    prior = F.when(is_llms_txt(F.col("url")), F.lit(PRIOR)).otherwise(F.lit(0.0))
    return fused.withColumn("source_prior", prior).withColumn("score", F.round(F.col("rrf") + prior, 6))


def overlap(terms: list[str], label: Column, heading_path: Column, plain_text: Column) -> Column:
    """How many of the terms are substrings of the chunk's label, headings and text."""
    hay = ascii_lower(F.concat_ws(" ", label, F.array_join(heading_path, " "), plain_text))
    return F.size(F.filter(F.array(*[F.lit(t) for t in terms]).cast("array<string>"), lambda t: F.contains(hay, t)))


def anchors(candidates: DataFrame) -> DataFrame:
    """At most three anchors a group: literal lexical hits, else lexical hits, else any, whichever tier comes first."""
    group = ["resource_id", "snapshot_id", "url"]
    tier = F.when(F.col("lexical_rank").isNotNull() & (F.col("overlap") > 0), 0).when(F.col("lexical_rank").isNotNull(), 1).otherwise(2)
    best = candidates.withColumn("tier", tier).withColumn("best", F.min("tier").over(Window.partitionBy(*group))).filter("tier = best")
    literal = F.when(F.col("tier") == 0, F.col("overlap")).otherwise(0)
    first = F.when(F.col("tier") == 0, F.col("lexical_rank")).otherwise(0)
    order = Window.partitionBy(*group).orderBy(literal.desc(), first, F.desc("score"), "chunk_key")
    return best.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= ANCHORS)


def groups(anchored: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """The best groups by the sum of their anchors' scores."""
    out = anchored.groupBy("resource_id", "snapshot_id", "url").agg(
        F.round(F.sum("score"), 6).alias("group_score"),
        F.array_sort(F.collect_set("chunk_index")).alias("anchor_chunks"),  # three at most
        F.min("chunk_index").alias("low"),
        F.max("chunk_index").alias("high"),
    )
    order = [F.desc("group_score"), "resource_id", "snapshot_id", "url"]
    return out.orderBy(*order).limit(top_k).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def context(chosen: DataFrame, chunks: DataFrame, width: int = CONTEXT) -> DataFrame:
    """The chunks of the same document within width of an anchor, once each, with their kind of evidence."""
    near = F.exists("anchor_chunks", lambda a: F.abs(a - F.col("chunk_index")) <= width)
    kind = (
        F.when(F.array_contains("anchor_chunks", F.col("chunk_index")), "match")
        .when(F.col("chunk_index") < F.col("low"), "context-before")
        .when(F.col("chunk_index") > F.col("high"), "context-after")
        .otherwise("context-between")
    )
    rows = chunks.select("resource_id", "snapshot_id", "url", "label", "chunk_index", "content")
    return rows.join(F.broadcast(chosen), ["resource_id", "snapshot_id", "url"]).filter(near).withColumn("evidence", kind)  # top_k groups


def within_budget(evidence: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Groups in rank order until the first that no longer fits; the first always stays."""
    cost = evidence.groupBy("rank").agg(F.sum(token_estimate(F.col("content"))).alias("tokens"))
    total = F.sum("tokens").over(Window.partitionBy(F.lit(0)).orderBy("rank"))
    kept = cost.withColumn("total", total).filter((F.col("rank") == 1) | (F.col("total") <= budget)).select("rank", "total")
    return evidence.join(F.broadcast(kept), "rank")


def context_ranges(chosen: DataFrame, width: int = CONTEXT) -> DataFrame:
    """Each group's ranges of chunks around its anchors; those that overlap or touch are one."""
    group = Window.partitionBy("resource_id", "snapshot_id", "url").orderBy("anchor")
    rows = chosen.select("rank", "resource_id", "snapshot_id", "url", F.explode("anchor_chunks").alias("anchor"))
    new = F.coalesce((F.col("anchor") - F.lag("anchor").over(group) > 2 * width + 1).cast("int"), F.lit(1))
    rows = rows.withColumn("new", new).withColumn("island", F.sum("new").over(group))
    ends = [F.greatest(F.min("anchor") - width, F.lit(0)).alias("first_chunk"), (F.max("anchor") + width).alias("last_chunk")]
    return rows.groupBy("rank", "resource_id", "snapshot_id", "url", "island").agg(*ends)


#: Columns of a chunk that evidence shows, and those it shows for debugging.
SHOWN = ["section_index", "heading_path", "heading_level", "anchor", "plain_text", "content_hash"]
DEBUG = ["chunk_key", "parent_section_index", "previous_section_index", "next_section_index"]


def evidence_items(kept: DataFrame, anchored: DataFrame, chunks: DataFrame, debug: bool = False) -> DataFrame:
    """A row for each chunk of the kept groups; scores and ranks on anchors alone."""
    at = ["resource_id", "snapshot_id", "url", "chunk_index"]
    scores = anchored.select(*at, F.col("score").alias("anchor_score"), "lexical_rank", "vector_rank", "lexical_score", "vector_score", "source_prior")
    facts = chunks.select(*at, "kind", *SHOWN, *DEBUG)
    rows = facts.join(F.broadcast(kept), at).join(F.broadcast(scores), at, "left")  # the anchors and neighbours of top_k groups
    out = ["rank", "kind", "label", F.col("url").alias("citation"), "snapshot_id", "group_score", "anchor_chunks", "chunk_index", "evidence", "content", *SHOWN, F.col("anchor_score").alias("score"), "lexical_rank", "vector_rank"]
    more = F.struct(*DEBUG, "lexical_score", "vector_score", F.when(F.col("source_prior") > 0, "llms_txt").alias("source_prior"), F.col("source_prior").alias("source_prior_score"))
    return rows.select(*out, *([more.alias("debug")] if debug else []))


def held(few: DataFrame) -> tuple[DataFrame, dict[str, list]]:
    """few as a local table, so that what follows neither plans nor runs its steps again, and the distinct values of its
    string columns. For rows that a limit bounds."""
    got = few.toArrow()
    return few.sparkSession.createDataFrame(got, few.schema), {c: got[c].unique().drop_null().to_pylist() for c, t in few.dtypes if t == "string"}


def results(items: DataFrame) -> DataFrame:
    """A row for each group, its evidence an array in the order of chunks (a handful for each of three anchors)."""
    group = ["rank", "kind", "label", "citation", "snapshot_id", F.col("group_score").alias("score"), F.col("anchor_chunks").alias("matched_chunk_indexes")]
    sections = F.array_sort(F.collect_set(F.when(F.array_contains("anchor_chunks", F.col("chunk_index")), F.col("section_index"))))
    item = F.struct("chunk_index", *[c for c in items.columns if c not in ("rank", "kind", "label", "snapshot_id", "group_score", "anchor_chunks", "chunk_index")])
    return items.groupBy(*group).agg(sections.alias("matched_section_indexes"), F.sort_array(F.collect_list(item)).alias("evidence"))


def search(
    chunks: DataFrame, terms: list[str], phrases: list[list[str]], vector: list[float] | None, allowed: DataFrame, top_k: int = TOP_K, budget: int = BUDGET, early: bool = False, debug: bool = False,
    index: DataFrame | None = None, stats: tuple[int, int] | None = None,
) -> DataFrame:
    """Evidence rows for a question over indexed chunks (with tokens and, for a vector, embedding).

    index: their blocks, and stats: the number of chunks and of their tokens; without them the phrases are counted in the chunks.
    allowed: resource_id of what the question may reach. Vectors are scoped before they are ranked; lexical hits after
    the candidate limit, or before it with early. BM25 statistics are always those of the whole index.

    The driver holds the candidates' keys and scores (a candidate limit of rows for each list), the anchors among them
    and the chosen groups (top_k), and names them to the scans that fetch their rows; the rest is lazy.
    """
    limit = candidate_limit(top_k)
    reach = allowed.select("resource_id").distinct()
    if index is None or stats is None:
        scored = bm25_of(chunks.select("resource_id", "snapshot_id", "chunk_key", "tokens"), phrases)
        scored = scored.join(reach, "resource_id", "left_semi") if early else scored
        hits = scored.select("resource_id", "snapshot_id", "chunk_key", "score").orderBy(F.desc("score"), "chunk_key").limit(limit).toArrow()
    else:
        hits = lexical_hits(index, *stats, phrases, limit, reach if early else None)
    if not early:
        found = hits.column("resource_id").unique().to_pylist()
        ids = reach.filter(among("resource_id", found)).toArrow().column("resource_id")  # as many as hits, at most
        hits = hits.filter(pc.is_in(hits.column("resource_id"), value_set=ids.combine_chunks()))
    near = None
    if vector is not None:
        reached = chunks.join(reach, "resource_id", "left_semi")
        near = top(cosine_scores(reached.select("resource_id", "snapshot_id", "chunk_key", "embedding"), vector), limit, "vector_rank")
    return evidence_for(numbered(hits, "lexical_rank"), near, chunks, terms, top_k, budget, debug)


def evidence_for(lexical: pa.Table, near: DataFrame | None, chunks: DataFrame, terms: list[str], top_k: int = TOP_K, budget: int = BUDGET, debug: bool = False) -> DataFrame:
    """Evidence rows from the ranked hits of a question (their keys, score and lexical_rank or vector_rank).

    chunks: every chunk of the documents that have a hit, and any others.
    """
    spark = chunks.sparkSession
    of = {c: lexical.column(c).unique().to_pylist() for c in ("resource_id", "snapshot_id", "chunk_key")}
    if near is not None:
        near, also = held(near)
        of = {c: sorted({*of[c], *also[c]}) for c in of}
    named = reduce(lambda x, y: x & y, [among(c, v) for c, v in of.items()])  # the partitions that the keys are in, and the keys
    facts = chunks.select("chunk_key", "resource_id", "snapshot_id", "url", "label", "chunk_index", "heading_path", "plain_text").filter(named)
    candidates = with_prior(facts.join(F.broadcast(fuse(spark.createDataFrame(lexical), near)), "chunk_key"))  # two candidate limits of rows
    counted = candidates.withColumn("overlap", overlap(terms, F.col("label"), F.col("heading_path"), F.col("plain_text")))
    few, _ = held(counted.drop("label", "heading_path", "plain_text"))
    best, _ = held(anchors(few.coalesce(1)))  # in one partition, a few hundred rows need no shuffle
    chosen, of = held(groups(best.coalesce(1), top_k))
    beside = chunks.filter(reduce(lambda x, y: x & y, [among(c, of[c]) for c in ("resource_id", "snapshot_id", "url")]))
    kept = within_budget(context(chosen, beside), budget)
    return evidence_items(kept.select("rank", "resource_id", "snapshot_id", "url", "label", "group_score", "anchor_chunks", "chunk_index", "evidence", "content"), best, beside, debug)
