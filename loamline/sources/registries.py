"""Registries of research papers: which URLs name a paper, and the pages of one."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import papers, urls
from . import fetch


class PaperRegistry(Protocol):
    """name: as snapshots and ids state it; prefix: what a paper's id is put after to give its address."""

    name: str
    prefix: str

    def paper(self, url: Column) -> Column:
        """The id of the paper that a URL names; null or empty if it names none of this registry."""

    def pages(self, spark: SparkSession, paper: str, transport: fetch.Transport) -> tuple[DataFrame, str | None]:
        """page_index, url and content of a paper, and its version; a ValueError if there is no such paper."""


class Arxiv:
    name, prefix, full = "arxiv", "https://arxiv.org/abs/", "https://arxiv.org/html/"

    def paper(self, url: Column) -> Column:
        return F.when(urls.input_kind(url) == "research_paper", urls.arxiv_id(url))

    def pages(self, spark: SparkSession, paper: str, transport: fetch.Transport) -> tuple[DataFrame, str | None]:
        """The header made from the paper's record, then its full text, where the registry has that."""
        record, full, found = self.prefix + paper, self.full + paper, F.lit(paper)
        got = fetch.fetch_bodies(spark.createDataFrame([(record,), (full,)], "url string"), transport).checkpoint()
        about = got.filter(F.col("url") == record).withColumn("paper", papers.paper_metadata(F.col("body")))
        about = about.withColumn("version", F.coalesce(papers.paper_version(F.col("paper.page_url")), papers.paper_version(found)))
        about = about.withColumn("content", papers.paper_header(found, F.col("version"), F.col("paper")))
        first = about.select("error", "paper.title", "version").first()
        if first["error"] is not None or first["title"] is None:
            raise ValueError(f"no paper at {record}: {first['error'] or 'no title or abstract'}")
        rest = got.filter((F.col("url") == full) & F.col("error").isNull()).withColumn("content", papers.paper_text(F.col("body"))).filter("content IS NOT NULL")
        at = lambda df, i: df.select(F.lit(i).cast("long").alias("page_index"), "url", "content")
        return at(about, 0).unionByName(at(rest, 1)), first["version"]
