"""The registered queries of this subpackage: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, quality_classifier, toxicity
from .common import settled, shared_dir
from .exact_dedup import exact_dedup, normalised_sha256
from .hard_negatives import hard_negatives
from .importance import importance_resample
from .jaccard_join import jaccard_join
from .line_dedup import line_dedup
from .mixing import mix
from .packing import pack
from .quality_rules import default_rules, quality_rules, with_counts
from .subword import held_out
from .token_counts import KEYS, TokenRollup, count_tokens
from .top_k import top_k


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact token counts of the documents that have tokens, by four batches of changes.

    Every document is inserted with an estimate, its language unknown; a revision moves it to its language, tokenizer
    and exact count; documents without tokens are deleted; what has been committed is compacted and the last two batches
    are replayed, to no effect.
    """
    counted = settled(count_tokens(documents(spark, sf_dir), keep=("source", "lang")))
    no_lang, estimate = F.lit(None).cast("string"), F.ceil(F.col("n_bytes") / 4).cast("long")
    rough = (F.col("source"), no_lang, F.lit("bytes_4"), estimate)
    exact = (F.col("source"), F.col("lang"), F.lit("byte_bpe_50k"), F.col("tokens"))
    none = (no_lang, no_lang, no_lang, F.lit(None).cast("long"))
    side = lambda prefix, values: [c.alias(prefix + k) for k, c in zip((*KEYS, "tokens"), values, strict=True)]
    change = lambda rows, op, new, old: rows.select(F.lit(op).alias("op"), *side("", new), *side("old_", old))
    revised = change(counted, "revise", exact, rough)
    dropped = change(counted.filter("tokens = 0"), "delete", none, exact)
    rollup = TokenRollup(spark, f"{shared_dir(spark)}/loamline-rollup-{uuid.uuid4().hex}")
    rollup.apply("estimates", change(counted, "insert", rough, none))
    rollup.apply("exact", revised)
    rollup.apply("without tokens", dropped)
    rollup.compact()
    rollup.apply("exact", revised)
    rollup.apply("without tokens", dropped)
    return rollup.totals()


def labelled(spark: SparkSession, sf_dir: str, label: str, folds: int, fold: int) -> tuple[DataFrame, DataFrame]:
    """Texts, and the labels that a model may learn from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out("doc_id", folds, fold))
    return documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text"), labels.select(F.col("doc_id").alias("id"), F.col(label).alias("label"))


def judged(scored: DataFrame, folds: int, fold: int, threshold: float) -> DataFrame:
    predicted = (F.col("score") >= threshold).cast("int").alias("predicted")
    more = [c for c in scored.columns if c not in ("doc_id", "score")]
    return scored.select("doc_id", held_out("doc_id", folds, fold).alias("held_out"), "score", predicted, *more)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = quality_classifier.fit(*labelled(spark, sf_dir, "quality", 5, 0))
    return judged(quality_classifier.score(documents(spark, sf_dir), model), 5, 0, 0.3)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = toxicity.fit(*labelled(spark, sf_dir, "toxic", 3, 1))
    return judged(toxicity.score(documents(spark, sf_dir), model), 3, 1, 0.7)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(documents(spark, sf_dir))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = jaccard_join(documents(spark, sf_dir), words=4, threshold=85)
    return joined.select("doc_id", "n_shingles", "component_id", "class_id")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(documents(spark, sf_dir), host_col="source")
    return out.select("doc_id", "source", "n_lines", "n_dropped", "text")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir), carry={"text_sha256": normalised_sha256(F.col("text"))})


def language_model(docs: DataFrame) -> language_id.LanguageModel:
    """A model of the languages of docs, learned from four of five documents."""
    known = docs.filter(~held_out("doc_id", 5, 0)).select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("label"))
    return language_id.fit(known.select("id", "text"), known.select("id", "label"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = language_id.identify(docs.select("doc_id", "text"), language_model(docs))
    return found.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score", "spans")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts go first, for every row; the cascade then does its own work on rows that pass them."""
    counted = with_counts(documents(spark, sf_dir).select("doc_id", "text"))
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = quality_rules(counted, default_rules(counted=True), key_cols=["doc_id"], skip=base_failed)
    judged = judged.withColumn("base_failed", base_failed).withColumn("kept", ~base_failed & F.col("rejected_by").isNull())
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(embeddings(spark, sf_dir).withColumn("label", label), F.col("vec_id") % 50 == 0)


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(embeddings(spark, sf_dir), F.col("vec_id") % 50 == 0)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance_resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_quality_classifier": op2_quality_classifier,
    "op4_toxicity": op4_toxicity,
    "op3_packing": op3_packing,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_line_dedup": op6_line_dedup,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_language_id": op8_language_id,
    "op9_mixing": op9_mixing,
    "op10_quality_rules": op10_quality_rules,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_exact_topk": op12_exact_topk,
    "op13_importance_resampling": op13_importance_resampling,
}

#: DuckDB reads these whole tables too. They state each result plainly, with none of the operators' steps.
ORACLES: dict[str, str] = {
    "op6_line_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT rid, source, unnest(lines) AS line FROM d),
t AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
b AS (SELECT l.source, l.line FROM l JOIN t ON l.source IS NOT DISTINCT FROM t.source
      WHERE regexp_matches(l.line, '[^\x20\x09-\x0D]') GROUP BY l.source, l.line, t.total
      HAVING count(DISTINCT l.rid) >= 3 AND count(DISTINCT l.rid) > 0.05 * t.total),
h AS (SELECT source, list(line) AS bad FROM b GROUP BY source),
k AS (SELECT d.*, list_filter(d.lines, lambda x: NOT list_contains(coalesce(h.bad, []), x)) AS kept
      FROM d LEFT JOIN h ON d.source IS NOT DISTINCT FROM h.source),
s AS (SELECT *, text IS NOT NULL AS cut FROM k)
SELECT doc_id, source, coalesce(len(lines), 0)::BIGINT AS n_lines,
       CASE WHEN cut THEN len(lines) - len(kept) ELSE 0 END::BIGINT AS n_dropped,
       CASE WHEN cut THEN array_to_string(kept, chr(10)) ELSE text END AS text
FROM s""",
    "op7_exact_dedup": r"""
WITH n AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, h AS text_sha256
FROM n WINDOW w AS (PARTITION BY h)""",
    "op9_mixing": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  ('0x' || substr(md5('0|' || coalesce(doc_id::VARCHAR, '-')), 1, 15))::BIGINT AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
      FROM d GROUP BY source),
r AS (SELECT *, 2.0 * source_size AS cap, 2.0 * source_size / w AS lv, 1.5 * sum(source_size) OVER () AS goal FROM s),
v AS (SELECT a.lv, (max(a.goal) - sum(CASE WHEN b.lv <= a.lv THEN b.cap ELSE 0 END)) / nullif(sum(CASE WHEN b.lv > a.lv THEN b.w ELSE 0 END), 0) AS level
      FROM r a CROSS JOIN r b GROUP BY a.lv UNION ALL SELECT -1.0, max(goal) / sum(w) FROM r),
f AS (SELECT min(level) AS level FROM v WHERE level >= lv AND NOT EXISTS (SELECT 1 FROM r WHERE r.lv > v.lv AND r.lv < v.level)),
g AS (SELECT source, source_size, least(cap, w * (SELECT level FROM f))::DOUBLE AS target FROM r),
c AS (SELECT d.doc_id, d.size, g.source_size, g.target, round(g.target)::BIGINT AS q,
             (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.u, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS ahead
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(size, q - ahead)) + greatest(0, least(size, q - source_size - ahead)))::BIGINT AS taken
FROM c""",
    "op10_quality_rules": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS n FROM p),
c AS (SELECT rid, count(DISTINCT j)::BIGINT AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM g WHERE n > 1) GROUP BY rid),
l AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, len(string_split(text, chr(10))) AS all_lines FROM d),
k AS (SELECT d.rid, doc_id, text, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, all_lines
      FROM d JOIN l USING (rid) LEFT JOIN c USING (rid)),
r AS (SELECT *, CASE WHEN n_words = 0 THEN 'no_words' WHEN 100 * n_symbols > 20 * n_words THEN 'symbols'
                     WHEN word_chars / n_words NOT BETWEEN 2 AND 25 THEN 'word_length'
                     WHEN 100 * len(regexp_extract_all(text, '!!')) > 50 * n_words THEN 'shouting'
                     WHEN n_dup_lines >= 3 AND 100 * n_dup_lines > 70 * all_lines THEN 'copied_lines' END AS bad,
             n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad IS NULL AS kept
FROM r""",
    "op11_hard_negatives": r"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS anchor_id, c.vec_id AS other, c.label = q.label AS same, coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])), 0)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (SELECT anchor_id, positive_id, positive_score, s.other AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.other)::INT AS rank
      FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
    "op12_exact_topk": r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
           FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])), 0)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op13_importance_resampling": r"""
WITH bytes AS (SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab
               FROM (SELECT unnest(range(256))::BIGINT AS i)),
w AS (SELECT row_number() OVER () AS rid, doc_id, true AS raw, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
      UNION ALL SELECT NULL, NULL, false, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
f AS (SELECT rid, raw, unnest(words) AS word FROM w),
h AS (SELECT word, hex(encode(word)) AS x FROM f GROUP BY word),
b AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT)), lambda c, y: xor(c >> 8, tab[(xor(c, y) & 255) + 1])), 4294967295) % 10000 AS bucket FROM h, bytes),
c AS (SELECT bucket, count(*) FILTER (raw) AS s, count(*) FILTER (NOT raw) AS t FROM f JOIN b USING (word) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM c) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM c) + 10000)::DOUBLE)))::BIGINT AS gain FROM c),
m AS (SELECT rid, sum(gain)::BIGINT AS total, count(*) AS n FROM f JOIN b USING (word) JOIN g USING (bucket) WHERE raw GROUP BY rid),
d AS (SELECT w.doc_id, len(w.words)::BIGINT AS n_features, CASE WHEN m.n IS NULL THEN 0 ELSE (total - ((total % n) + n) % n) // n END::BIGINT AS weight, ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS hash
      FROM w LEFT JOIN m USING (rid) WHERE raw),
e AS (SELECT *, weight + floor(-1000 * ln(-ln((hash + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score, n_features >= 20 AS able FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id NULLS LAST) AS place, 10 * count(*) OVER (PARTITION BY able) // 100 AS drawn FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= drawn THEN place END::BIGINT AS rank FROM r""",
}
