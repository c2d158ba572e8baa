"""Quality rules as a short-circuit cascade.

Every rule is a predicate over columns of one row, with the work that it takes: a column that counts the characters it
goes through, in units of one plain scan. On a sample, drawn by hash, each rule's work and rejections are averaged; the
cascade then asks the rules in the order of rejections per unit of work, and a row that one rule rejects is not shown to
the next (SQL's CASE is lazy). Counted work, unlike seconds, is the same on every run, so reruns name the same rule.
The order changes the cost and the name only: a row is kept when no rule rejects it. All of it runs in the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SEPARATORS, WORD, fresh, whole_text

#: Rows, about, on which work and selectivities are estimated. They touch the order of the rules, never a verdict.
SAMPLE_ROWS = 512
#: Characters' worth of one comparison of numbers, and of splitting a text into lines, matching and comparing them.
COMPARE, LINES = 1.0, 4.0


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column
    #: The work of a row, in characters scanned.
    work: Column | None = None
    #: Set by estimate(): averages over the sample.
    cost: float = 0.0
    rejected: float = 0.0

    @property
    def worth(self) -> float:
        return self.rejected / max(self.cost, COMPARE)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def word_chars(text: Column) -> Column:
    return (F.char_length(text) - F.regexp_count(text, F.lit(SEPARATORS))).cast("long")


def n_symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def with_counts(docs: DataFrame, text_col: str = "text", window: int = 3) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long) of each whole text (null: none).

    n_repeat_words: words inside windows of three words that occur twice or more in the text, first occurrences
    included. Windows are compared by a 64-bit hash. Only in texts where a window repeats are the hashes sorted with
    their places; those with an equal neighbour are kept, and the union of the intervals they cover is summed up:
    n log n in the words of one text, no pairs of windows. Each step is a column of its own, as a lambda's body that
    names an array expression would compute it anew for every element.
    An empty text has 0 of each. Columns of docs with these names are replaced; all others pass through.
    """
    text, tokens, hashes, placed, at = (fresh(docs, x) for x in ("lm_text", "lm_words", "lm_hashes", "lm_placed", "lm_at"))
    n = F.size(tokens)
    h, p, t = F.col(hashes), F.col(placed), F.col(text)
    starts = F.when(n >= window, F.sequence(F.lit(0), n - window)).otherwise(F.array().cast("array<int>"))
    same = lambda x, i: (x.h == F.get(p, i + 1).h) | ((i > 0) & (x.h == F.get(p, i - 1).h))
    out = docs.withColumn(text, whole_text(F.col(f"`{text_col}`"))).withColumn(tokens, words(t))
    out = out.withColumn(hashes, F.transform(starts, lambda i: F.xxhash64(*[F.get(F.col(tokens), i + j) for j in range(window)])))
    out = out.withColumn(placed, F.when(F.size(F.array_distinct(h)) < F.size(h), F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    out = out.withColumn(at, F.sort_array(F.transform(F.filter(p, same), lambda x: x.i)))
    covered = F.aggregate(
        F.col(at),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda s, i: F.struct((s.n + (i + window - F.greatest(i, s.end))).cast("long").alias("n"), (i + window).alias("end")),
        lambda s: s.n,
    )
    made = {"n_words": n.cast("long"), "word_chars": word_chars(t), "n_symbols": n_symbols(t), "n_dup_lines": n_dup_lines(t), "n_repeat_words": F.coalesce(covered, F.lit(0).cast("long"))}
    return out.withColumns(made).drop(text, tokens, hashes, placed, at)


def default_rules(text_col: str = "text", counted: bool = False) -> list[Rule]:
    """Rules whose thresholds reject junk, not odd prose: lists of symbols, shouting, lines copied again and again.

    counted: the rows carry the columns of with_counts(), which then need not be computed again.
    """
    t = whole_text(F.col(f"`{text_col}`"))
    count, chars, symbols, dup = (F.col("n_words"), F.col("word_chars"), F.col("n_symbols"), F.col("n_dup_lines")) if counted else (n_words(t), word_chars(t), n_symbols(t), n_dup_lines(t))
    some = F.greatest(count, F.lit(1))
    scan, free = F.char_length(t).cast("double"), F.lit(COMPARE)
    of = lambda scans: free if counted else scans * scan
    newlines = F.regexp_count(t, F.lit("\n")) + 1
    return [
        Rule("no_words", count == 0, of(1)),
        Rule("symbols", 100 * symbols > 20 * some, of(2)),
        Rule("word_length", ~(chars / some).between(2, 25), of(3)),
        Rule("shouting", 100 * F.regexp_count(t, F.lit("!!")) > 50 * some, scan if counted else 2 * scan),
        Rule("copied_lines", (dup >= 3) & (100 * dup > 70 * newlines), F.when(dup >= 3, scan).otherwise(free) if counted else LINES * scan),
    ]


def estimate(docs: DataFrame, rules: list[Rule], key: list[Column], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """rules with their work and share of rejections on a sample, the most rejections per work first.

    The sample are rows whose hash of key falls in a share of all hashes that sample_rows of docs are expected in; one
    job sums over it where it lies, however many rows share a key. Ties (rules that reject nothing) go to the cheaper
    rule, then to the name. An empty sample leaves every share at 0. A rule that states no work counts as one scan of
    all text columns.
    """
    n = docs.count()
    sample = docs.filter(F.pmod(F.xxhash64(*key), F.lit(max(1, n // sample_rows))) == 0)
    texts = [F.coalesce(F.char_length(F.col(f"`{f.name}`")), F.lit(0)) for f in docs.schema.fields if f.dataType.simpleString() == "string"]
    all_text = sum(texts, F.lit(0))
    work = [F.avg((all_text if r.work is None else r.work).cast("double")).alias(f"work_{i}") for i, r in enumerate(rules)]
    hits = [F.avg(F.coalesce(r.rejects, F.lit(False)).cast("double")).alias(f"hits_{i}") for i, r in enumerate(rules)]
    seen = sample.agg(*work, *hits).first() if rules else None
    out = [replace(r, cost=seen[f"work_{i}"] or 0.0, rejected=seen[f"hits_{i}"] or 0.0) for i, r in enumerate(rules)]
    return sorted(out, key=lambda r: (-r.worth, r.cost, r.name))


def cascade(rules: list[Rule]) -> Column:
    """The name of the first rule that rejects a row, null if none does."""
    verdict = F.when(F.lit(False), F.lit(None).cast("string"))
    for rule in rules:
        verdict = verdict.when(rule.rejects, F.lit(rule.name))
    return verdict


def quality_rules(docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text", key_cols: list[str] | None = None, skip: Column | None = None, sample_rows: int = SAMPLE_ROWS, out_col: str = "rejected_by") -> DataFrame:
    """docs with rejected_by: the first rule of the estimated order that rejects the row, or null for kept rows.

    key_cols draw the sample (the text, if none are named). skip: rows of which it is true are not shown to any rule
    and get null. Null text counts as empty. A rule that gives null does not reject. Repeated rows get equal verdicts;
    an empty table gives an empty one. Other columns pass through; a column named as out_col is replaced.
    """
    rules = default_rules(text_col) if rules is None else rules
    rules = estimate(docs, rules, [F.col(f"`{c}`") for c in key_cols or [text_col]], sample_rows)
    verdict = cascade(rules)
    return docs.withColumn(out_col, verdict if skip is None else F.when(~F.coalesce(skip, F.lit(False)), verdict))
