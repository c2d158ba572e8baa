"""The versioned catalog: resources, snapshots, current pointers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrow import bounded_batches

HASHED = ["resource_id", "snapshot_id", "page_count", "content_hash"]


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digests of runs of sorted pages; a run may go on in the next batch, and only its digest's state is kept."""
    key, state, count = None, None, 0
    done = lambda: pd.DataFrame([(*key, count, state.hexdigest())], columns=HASHED)
    for batch in batches:
        for resource, snapshot, url, content in batch.itertuples(index=False):
            if state is None or key != (resource, snapshot):
                if state is not None:
                    yield done()
                key, state, count = (resource, snapshot), hashlib.sha256(), 0
            count += 1
            if url is not None and content is not None:
                state.update(f"{url}\n{content}\n".encode())
    if state is not None:
        yield done()


def snapshot_hash(pages: DataFrame) -> DataFrame:
    """resource_id, snapshot_id, page_count and content_hash of the pages in order.

    The hash of a snapshot is sequential by definition; its pages stream through one task, which holds a batch at once.
    Pages with a null URL or content count, but add nothing to the hash.
    """
    bounded_batches(pages.sparkSession)
    keys = ["resource_id", "snapshot_id"]
    rows = pages.select(*keys, "page_index", "url", "content").repartition(*keys).sortWithinPartitions(*keys, "page_index", "url")
    return rows.select(*keys, "url", "content").mapInPandas(_digests, "resource_id string, snapshot_id string, page_count long, content_hash string")


def listing(resources: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Every resource with its number of snapshots and the pages and hash of the current one."""
    s = snapshots.select("resource_id", "snapshot_id", "page_count", "content_hash")
    current = F.col("snapshot_id") == F.col("current")
    keys = ["id", "label", "kind", "url", "current"]
    return (
        resources.join(s, resources["id"] == s["resource_id"], "left")
        .groupBy(*keys)
        .agg(F.count("snapshot_id").alias("snapshots"), F.max(F.when(current, F.col("page_count"))).alias("page_count"), F.max(F.when(current, F.col("content_hash"))).alias("content_hash"))
    )


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """table with rows put in: of each key the row of the largest version stays, a new row before an old one."""
    both = table.withColumn("lm_new", F.lit(0)).unionByName(rows.withColumn("lm_new", F.lit(1)))
    latest = Window.partitionBy(*keys).orderBy(F.desc(version), F.desc("lm_new"))
    return both.withColumn("lm_n", F.row_number().over(latest)).filter("lm_n = 1").drop("lm_n", "lm_new")


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """For each resource whether its new snapshot differs; a missing old one counts as different."""
    old = before.select("resource_id", F.col("content_hash").alias("old_hash"))
    return after.join(old, "resource_id", "left").select("resource_id", "content_hash", (~F.col("content_hash").eqNullSafe(F.col("old_hash"))).alias("changed"))


def removed(table: DataFrame, ids: DataFrame, key: str = "resource_id") -> DataFrame:
    return table.join(ids.select(F.col("id").alias(key)), key, "left_anti")


def find_target(resources: DataFrame, target: str) -> DataFrame:
    """The resource with this label, URL or id; of several the latest, then the smallest id."""
    hit = (F.col("label") == target) | (F.col("url") == target) | (F.col("id") == target)
    return resources.filter(hit).orderBy(F.desc("updated_at"), "id").limit(1)


def trusted(links: DataFrame, resources: DataFrame) -> DataFrame:
    """Project links with kind, URL and pointer from the catalog alone; the link's reason goes first."""
    r = resources.select("id", "kind", "url", "current", F.col("reason").alias("known"))
    return links.select("id", F.col("reason").alias("given")).join(r, "id").select("id", "kind", "url", "current", F.coalesce("given", "known").alias("reason"))


def history(resources: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The snapshots of each resource by place, the latest first; of equal times the larger id."""
    s = snapshots.join(resources.select(F.col("id").alias("resource_id"), "label", "current"), "resource_id")
    latest = Window.partitionBy("resource_id").orderBy(F.desc("fetched_at"), F.desc("snapshot_id"))
    return s.withColumn("place", F.row_number().over(latest)).withColumn("is_current", F.col("snapshot_id").eqNullSafe(F.col("current")))


def linked(listing: DataFrame, links: DataFrame, project_only: bool = False) -> DataFrame:
    """A listing with linked: whether the project links the resource; or only those it links."""
    ids = links.select(F.col("id").alias("link_id")).distinct()
    out = listing.join(ids, F.col("id") == F.col("link_id"), "left").withColumn("linked", F.col("link_id").isNotNull()).drop("link_id")
    return out.filter("linked") if project_only else out


def queryable(resources: DataFrame, label: str | None = None, kind: str | None = None) -> DataFrame:
    """The resources a question may reach: never source trees; with this label and kind, where given."""
    out = resources.filter(F.col("kind").isin("docs", "notes", "research_paper"))
    out = out if label is None else out.filter(F.col("label") == label)
    return out if kind is None else out.filter(F.col("kind") == kind)


def nearest_ranks(rows: DataFrame, value: str, points: dict[str, float]) -> DataFrame:
    """One row: for each named p the value at place round((n - 1) * p), halves to even; null where there are no values.

    Equal values are counted first, so a frequent one is one row; the rest is sorted by ranges. The driver sees a number
    for each range, and a range numbers its own rows alone.
    """
    counted = rows.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))
    ranged = counted.repartitionByRange("value").withColumn("part", F.spark_partition_id()).checkpoint()
    sums = sorted((r["part"], r["n"]) for r in ranged.groupBy("part").agg(F.sum("n").alias("n")).collect())
    total, wanted = sum(n for _, n in sums), []
    for name, p in points.items():
        place, before = round((total - 1) * p), 0
        for part, n in sums:
            if place < before + n:
                wanted.append((name, part, place - before))
                break
            before += n
    asked = rows.sparkSession.createDataFrame(wanted, "name string, part int, place long")
    upto = F.sum("n").over(Window.partitionBy("part").orderBy("value"))
    few = ranged.filter(F.col("part").isin([w[1] for w in wanted])).withColumn("upto", upto)
    found = few.join(F.broadcast(asked), "part").filter((F.col("place") < F.col("upto")) & (F.col("place") >= F.col("upto") - F.col("n")))
    return found.agg(*[F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in points])
