"""Line deduplication by site-relative frequency: lines on too large a share of their host's pages are dropped.

Pages that contain a line are counted by host and line hash, with partial sums before the shuffle. A host has at most
(lines per page / max_ratio) boilerplate lines, so the array of a host's boilerplate is bounded whatever the host's
size. While all hosts' lines together are few, their arrays are broadcast; beyond that only those of the hosts with most
pages are, which are few by definition, and the rest meet by host. All of it runs in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, WORD, fresh, settled, whole_text

MAX_RATIO = 0.05
#: A line on fewer pages than this is no boilerplate, whatever its share: on a host of one page every line is on all pages.
MIN_PAGES = 3
#: A host with more than one in so many of all pages is hot; there are fewer hot hosts than this.
HOT_SHARE = 1000


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _key(line: Column) -> Column:
    """96 bits: with 64, some lines of a very large host would meet by chance."""
    return F.struct(F.xxhash64(line).alias("a"), F.hash(line).alias("b"))


def _has_word(line: Column) -> Column:
    return line.rlike(WORD)


def boilerplate(docs: DataFrame, host: Column, text: Column, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """host and lines: the keys of the host's lines that are on over max_ratio of its pages and on min_pages at least."""
    rows = docs.select(host.alias("host"), whole_text(text).alias("text"))
    totals = rows.groupBy("host").agg(F.count("*").alias("total")).withColumnRenamed("host", "total_host")
    keys = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), _has_word), _key))
    counts = rows.select("host", F.explode(keys).alias("line")).groupBy("host", "line").agg(F.count("*").alias("pages")).filter(F.col("pages") >= min_pages)
    common = counts.join(totals, F.col("host").eqNullSafe(F.col("total_host"))).filter(F.col("pages") > max_ratio * F.col("total"))
    return common.groupBy("host").agg(F.collect_list("line").alias("lines"), F.first("total").alias("total"))


def line_dedup(
    docs: DataFrame,
    host_col: str = "source",
    text_col: str = "text",
    max_ratio: float = MAX_RATIO,
    min_pages: int = MIN_PAGES,
    keep_whole: bool = False,
    lines_col: str = "n_lines",
    dropped_col: str = "n_dropped",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """docs with the boilerplate lines taken out of the text, and the numbers of lines and of dropped lines (long).

    Lines are what newlines separate; lines with no word are neither counted nor dropped. Every occurrence of a
    boilerplate line is dropped. keep_whole: a page whose lines with words all are boilerplate is taken for a copy of a
    page, not site furniture, and stays as it is. Rows with a null host form one host. A null text stays null, with no
    lines; an empty table gives an empty one. Repeated rows are pages of their own. Ties at exactly max_ratio are kept.
    Other columns pass through; columns named as lines_col and dropped_col are replaced.
    """
    found = settled(boilerplate(docs, F.col(f"`{host_col}`"), F.col(f"`{text_col}`"), max_ratio, min_pages))
    host, bad, kept, some = (fresh(docs, x) for x in ("lm_host", "lm_bad", "lm_kept", "lm_some"))
    text, lines = F.col(f"`{text_col}`"), _lines(F.col(f"`{text_col}`"))
    size = found.agg(F.coalesce(F.sum(F.size("lines")), F.lit(0))).first()[0]
    if size <= broadcast_rows:
        few = found.select(F.col("host").alias(host), F.col("lines").alias(bad))
        joined = docs.join(F.broadcast(few), docs[f"`{host_col}`"].eqNullSafe(few[host]), "left").drop(host)
    else:
        is_hot = F.col("total") > docs.count() // HOT_SHARE
        hot = found.filter(is_hot).select(F.col("host").alias(host), F.col("lines").alias(bad))
        joined = docs.join(F.broadcast(hot), docs[f"`{host_col}`"].eqNullSafe(hot[host]), "left").drop(host)
        # pages of hot hosts, and of hosts without boilerplate, are dealt by their text, which meets nothing
        cold, more, key, mine = found.filter(~is_hot), *(fresh(docs, x) for x in ("lm_more", "lm_key", "lm_mine"))
        cold = cold.select(F.xxhash64(F.lit(0), "host").alias(key), F.col("host").alias(host), F.col("lines").alias(more))
        spread = F.when(F.col(bad).isNull(), F.xxhash64(F.lit(0), F.col(f"`{host_col}`"))).otherwise(F.xxhash64(F.lit(1), text))
        joined = joined.withColumn(mine, spread)
        at = (joined[mine] == cold[key]) & docs[f"`{host_col}`"].eqNullSafe(cold[host])
        joined = joined.join(cold, at, "left").withColumn(bad, F.coalesce(bad, more)).drop(host, more, key, mine)
    good = F.filter(lines, lambda line: ~F.array_contains(F.col(bad), _key(line)) | ~_has_word(line))
    out = joined.withColumn(kept, F.when(F.col(bad).isNotNull() & text.isNotNull(), good))
    out = out.withColumn(some, F.exists(F.col(kept), _has_word) if keep_whole else F.col(kept).isNotNull())
    return out.withColumns(
        {
            lines_col: F.when(text.isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long"),
            dropped_col: F.when(F.col(some), F.size(lines) - F.size(F.col(kept))).otherwise(0).cast("long"),
            text_col: F.when(F.col(some), F.array_join(F.col(kept), "\n")).otherwise(text),
        }
    ).drop(bad, kept, some)
