"""Pages that land in a folder, streamed into a store; what has come of each snapshot is the stream's state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..sources.store import Store, put

LANDED = "resource_id string, snapshot_id string, kind string, label string, page_index long, url string, content string"
#: Files may say how many pages the snapshot has; where none says so, every batch of it is the last so far.
COUNTED = f"{LANDED}, page_count long"
NEW = f"{COUNTED}, whole boolean"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class NewPages(StatefulProcessor):
    """The pages of a snapshot that have not come before, each once; whole marks those with which the snapshot is complete.

    The state holds a snapshot's page numbers, one entry each, and their count, so a batch touches its own pages alone.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "page_index long", "there boolean")
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = []
        n = self.count.get()[0] if self.count.exists() else 0
        for batch in rows:
            for row in batch.itertuples(index=False):
                page = (int(row.page_index),)
                if not self.seen.containsKey(page):
                    self.seen.updateValue(page, (True,))
                    fresh.append(row)
        if fresh:
            n += len(fresh)
            self.count.update((n,))
            counts = [int(r.page_count) for r in fresh if not pd.isna(r.page_count)]
            out = pd.DataFrame(fresh)
            out["page_count"] = out["page_count"].astype("Int64")
            out["whole"] = not counts or n >= max(counts)
            yield out

    def close(self) -> None:
        pass


def new_pages(landed: DataFrame) -> DataFrame:
    """A stream of landed pages (COUNTED) without repeated ones, and with whole (see NewPages). Pages without a number are dropped.

    The session keeps its stream state in RocksDB from now on, as state of this kind needs.
    """
    landed.sparkSession.conf.set(STATE_STORE, ROCKS)
    keyed = landed.filter("page_index IS NOT NULL AND resource_id IS NOT NULL AND snapshot_id IS NOT NULL").groupBy("resource_id", "snapshot_id")
    return keyed.transformWithStateInPandas(statefulProcessor=NewPages(), outputStructType=NEW, outputMode="Append", timeMode="None")


def ingest(spark: SparkSession, store: Store, landing: str, checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
    """A query that takes in what Parquet files (LANDED or COUNTED) there are in landing, and ends.

    A page is stored when it first comes, in its micro-batch's own partition, so a batch that runs again leaves no second copy.
    A snapshot is cut into chunks and indexed once, by the batch that makes it whole, and one commit then shows it.
    """

    def take(batch: DataFrame, number: int) -> None:
        staged, rows = store.stage(batch)
        try:
            store.put_pages(rows.withColumn("batch", F.lit(number).cast("long")))
            whole = rows.filter("whole").select("resource_id", "snapshot_id").distinct()
            if not whole.isEmpty():
                indexed = store.index(store.pages().join(whole, ["resource_id", "snapshot_id"], "left_semi"))
                store.commit(lambda root: {"stats": put(root.table("stats"), indexed, ["resource_id", "snapshot_id"])})
        finally:
            store.files.delete(staged)

    pages = new_pages(spark.readStream.schema(COUNTED).option("maxFilesPerTrigger", files_per_batch).parquet(landing))
    return pages.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
