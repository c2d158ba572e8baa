"""Bounded breadth-first crawls: over a table of links, and over what a fetcher brings."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.urls import canonical_url, in_llms_scope, in_scope, is_llms_txt, llms_candidates
from .checkpoints import ensure_checkpoints


class Seen:
    """The URLs that a crawl has met, a level at a time, in a folder of the shared checkpoints: none is written twice."""

    def __init__(self, urls: DataFrame):
        ensure_checkpoints(urls.sparkSession)
        self.spark = urls.sparkSession
        self.path = f"{self.spark.sparkContext.getCheckpointDir()}/loamline-seen-{uuid.uuid4().hex}"
        self.add(urls)

    def add(self, urls: DataFrame) -> None:
        urls.select("url").write.mode("append").parquet(self.path)

    def without(self, urls: DataFrame) -> DataFrame:
        """Those of urls that have not been met, each once."""
        return urls.distinct().join(self.spark.read.schema("url string").parquet(self.path), "url", "left_anti")


def bounded_bfs(nodes: DataFrame, edges: DataFrame, seed: DataFrame, max_pages: int) -> DataFrame:
    """url, level and page_order of what a crawl from seed fetches, level by level, at most max_pages pages.

    nodes: url of the pages that can be fetched; edges: src, dst; seed: url. Each level takes the first of its sorted
    frontier as far as the cap goes; what the cap or a failed fetch drops stays seen. Levels are driver rounds, each
    cut from its lineage in the checkpoint folder; rows stay distributed but for the level's numbering, which the cap
    bounds.
    """
    frontier, fetched, level, count = seed.select("url").distinct(), None, 0, 0
    seen = Seen(frontier)
    while count < max_pages:
        room = max_pages - count
        batch = frontier.orderBy("url").limit(room) if frontier.count() > room else frontier
        got = batch.join(nodes.select("url"), "url", "left_semi")
        order = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("url"))
        page = got.select("url", F.lit(level).alias("level"), (order + count - 1).cast("long").alias("page_order")).checkpoint()
        size = page.count()
        if size:
            fetched = page if fetched is None else fetched.unionByName(page)
        if not size:
            break
        count += size
        found = edges.join(page.select(F.col("url").alias("src")), "src", "left_semi").select(F.col("dst").alias("url"))
        frontier = seen.without(found).checkpoint()
        seen.add(frontier)
        level += 1
    return fetched if fetched is not None else nodes.select("url", F.lit(0).alias("level"), F.lit(0).cast("long").alias("page_order")).limit(0)


#: The most pages a crawl fetches unless told otherwise.
MAX_PAGES = 2048


def site(spark: SparkSession, seed: str, fetch: Callable[[DataFrame], DataFrame], max_pages: int = MAX_PAGES) -> DataFrame:
    """page_index, url and content of a site's pages from seed, at most max_pages.

    fetch turns a table of url into url, page_url, content, links and error, its calls spread over the executors.
    The first llms.txt found is page 0 and its links, in their order, come before the seed; from then on each level
    goes in the order of URLs. Failed fetches are left out. Seen URLs stay distributed; the driver holds counts alone.
    """
    of = lambda urls: spark.createDataFrame([(u,) for u in urls], "url string")
    at = spark.createDataFrame([(seed,)], "seed string").select(llms_candidates(F.col("seed")).alias("llms"), is_llms_txt(F.col("seed")).alias("own"), canonical_url(F.col("seed")).alias("seed")).first()
    pages, tried, frontier = None, [], None
    for candidate in at["llms"]:  # three at most
        tried.append(candidate)
        got = fetch(of([candidate])).filter("error IS NULL").checkpoint()
        if not got.isEmpty():
            pages = got.select(F.lit(0).cast("long").alias("page_index"), F.col("page_url").alias("url"), "content")
            found = got.select(F.posexplode("links").alias("place", "url")).withColumn("url", canonical_url(F.col("url"))).filter(in_llms_scope(F.lit(candidate), F.col("url")))
            frontier = found.groupBy("url").agg(F.min("place").alias("place")).join(of(tried), "url", "left_anti").select("url", F.lpad(F.col("place").cast("string"), 10, "0").alias("place"))
            break
    first = spark.createDataFrame([] if at["own"] else [(at["seed"], "last")], "url string, place string")
    frontier = first if frontier is None else frontier.unionByName(first.join(frontier.select("url"), "url", "left_anti"))
    frontier = frontier.join(of(tried), "url", "left_anti").checkpoint()
    seen = Seen(frontier.select("url").unionByName(of(tried)))
    count = 0 if pages is None else 1
    while count < max_pages and not frontier.isEmpty():
        batch = frontier.orderBy("place", "url").limit(max_pages - count)
        got = fetch(batch.select("url")).filter("error IS NULL").join(batch, "url").checkpoint()
        order = Window.partitionBy(F.lit(0)).orderBy("place", "url")  # max_pages rows at most
        level = got.select((F.row_number().over(order) + count - 1).cast("long").alias("page_index"), F.col("page_url").alias("url"), "content")
        pages = level if pages is None else pages.unionByName(level)
        count += got.count()
        found = got.select(F.explode("links").alias("url")).select(canonical_url(F.col("url")).alias("url")).filter(in_scope(F.lit(at["seed"]), F.col("url")))
        frontier = seen.without(found).withColumn("place", F.col("url")).checkpoint()
        seen.add(frontier)
    return pages if pages is not None else spark.createDataFrame([], "page_index long, url string, content string")
