"""The corpus pipeline: language ID, line dedup, n-gram Jaccard join, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame over all rows that its predecessor kept; all but the
last return the columns of documents. run() applies them one after another, each written to the shared folder as
Parquet and read again, so a lost executor never costs more than its own stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.llm import jaccard_join, language_id, line_dedup, mixing, packing
from loamline.llm.common import fresh, shared_dir
from loamline.llm.queries import language_model

#: A text none of whose languages reaches this mean probability is no text in a known language.
MIN_LANGUAGE_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str, min_score: float = MIN_LANGUAGE_SCORE) -> DataFrame:
    """Texts of no letters, or of no language that reaches min_score, go; a missing language is filled in.

    A null or empty text goes; rows of null ids, and repeated rows, are judged like any other. An empty table gives an
    empty one; so does one without any language to learn, as nothing can be told then. Columns of any names pass through.
    """
    name, score, spans = (fresh(docs, x) for x in ("lm_lang", "lm_score", "lm_spans"))
    found = language_id.identify(docs, language_model(docs), lang_col=name, score_col=score, spans_col=spans)
    kept = found.filter((F.col(name) != language_id.UNDETERMINED) & (F.col(score) >= min_score))
    return kept.withColumn("lang", F.coalesce("lang", name)).select(*docs.columns)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on too many of a source's documents go; n_chars follows the text.

    A page that is boilerplate in all its lines stays whole: it is one of many copies, of which the next stage keeps one,
    and here all of them would go. No row goes, whatever is null in it; an empty table gives an empty one. Columns of
    any names pass through.
    """
    lines, dropped = fresh(docs, "lm_lines"), fresh(docs, "lm_dropped")
    out = line_dedup.line_dedup(docs, host_col="source", keep_whole=True, lines_col=lines, dropped_col=dropped)
    return out.withColumn("n_chars", F.when(F.col(dropped) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five words, a similarity of 0.8 or more).

    The one of the smallest id; of rows that repeat an id one stays, and rows of a null id all do. A text without words
    is a copy of nothing. An empty table gives an empty one. Columns of any names pass through.
    """
    return jaccard_join.deduplicated(docs, words=5, threshold=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each drawing of a document, whole; where a quota ends within a document, its words up to there.

    Documents without words are drawn with their block. Null sources are one source; rows of null or repeated ids are
    documents of their own. An empty table gives an empty one. Columns of any names pass through.
    """
    drawn = mixing.mixed(mixing.mix(docs, carry=docs.columns))
    text, n_chars = F.col("row.text"), F.col("row.n_chars")
    pieces = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.array_join(F.slice(pieces, F.lit(1), F.col("draw_words").cast("int")), "")
    short = F.col("draw_words") < F.col("size")
    made = {"text": F.when(short, cut).otherwise(text), "n_chars": F.when(short, F.char_length(cut).cast("long")).otherwise(n_chars)}
    return drawn.select(*[made.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 2048 tokens, with their ids.

    A null text is an empty one, with an end id alone; rows of null or repeated ids are documents of their own. An empty
    table gives no pieces. Of other columns nothing is read.
    """
    return packing.pack(docs)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_boilerplate),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: SQL expresses neither the learned stage nor the tokenizer. The tests hold the stages' operators against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over the documents of sf_dir."""
    at = f"{shared_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
