"""The store: catalog tables, pages, and indexed chunks by partition, on any shared file system, under one root pointer.

A root is a small file that names one version of each catalog table; the statistics among them name the generation of
every snapshot's chunks and postings. A change writes new versions and generations beside the old ones and then puts the next
root, which succeeds only if nobody else has put it; the loser starts again from the root that won. Readers take one
root, so they see a change whole or not at all, whatever a killed writer has left; the root before the last one stays readable.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.embedding import Embedder, passage_vectors
from ..operators import chunking, inverted
from .files import RESOURCE, Files

SNAPSHOT = "resource_id string, snapshot_id string, kind string, source_url string, content_hash string, fetched_at string, page_count long, extra string, size_bytes long"
PAGES = "kind string, label string, page_index long, url string, content string, resource_id string, snapshot_id string, batch long"
#: Chunks and postings by partition; a generation is one indexing of a snapshot.
CHUNKS = (
    "kind string, label string, page_index long, url string, page_chunk int, chunk_index long, chunk_key string, content string, plain_text string, content_hash string, section_index int, "
    "heading_path array<string>, heading_level int, parent_section_index int, previous_section_index int, next_section_index int, anchor string, tokens array<string>, n_tokens int, embedding array<float>, "
    "resource_id string, snapshot_id string, generation string"
)
POSTINGS = f"{inverted.BLOCKS.removeprefix('resource_id string, snapshot_id string, ')}, resource_id string, snapshot_id string, generation string"
STATS = "resource_id string, snapshot_id string, generation string, n long, tokens long"
CATALOG = {"resources": RESOURCE, "snapshots": SNAPSHOT, "stats": STATS}
ROOTS, ATTEMPTS = "roots", 20
DYNAMIC = {"partitionOverwriteMode": "dynamic"}
#: The version of the store's layout, which signed stores state.
LAYOUT, SIGNATURE = "1.3.0", "store.json"


class Root:
    """One committed state of a store: what is read through it belongs together."""

    def __init__(self, store: Store, number: int, versions: dict[str, str]):
        self.store, self.number, self.versions = store, number, versions

    def table(self, name: str) -> DataFrame:
        spark, version = self.store.spark, self.versions.get(name)
        return spark.read.schema(CATALOG[name]).parquet(f"{self.store.home}/{name}/{version}") if version else spark.createDataFrame([], CATALOG[name])

    def _current(self, rows: DataFrame) -> DataFrame:
        keys = ["resource_id", "snapshot_id", "generation"]
        return rows.join(self.table("stats").select(*keys), keys, "left_semi")

    def chunks(self) -> DataFrame:
        return self._current(self.store.read("chunks", CHUNKS))

    def postings(self) -> DataFrame:
        return self._current(self.store.read("postings", POSTINGS))

    def statistics(self, current: DataFrame | None = None) -> tuple[int, int]:
        """The number of indexed chunks and of their tokens, of all snapshots or of those in current; no chunk is read."""
        rows = self.table("stats")
        rows = rows if current is None else rows.join(current, ["resource_id", "snapshot_id"], "left_semi")
        got = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
        return got[0], got[1]


class Table:
    """A catalog table as the last root has it."""

    def __init__(self, store: Store, name: str):
        self.store, self.name, self.schema = store, name, CATALOG[name]

    def read(self) -> DataFrame:
        return self.store.root().table(self.name)


def put(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table with rows in place of those with their keys."""
    return table.join(rows.select(*keys), keys, "left_anti").unionByName(rows)


class Store:
    def __init__(self, spark: SparkSession, home: str, embedder: Embedder | None = None):
        self.spark, self.home, self.embedder, self.files = spark, home.rstrip("/"), embedder, Files(spark)
        self.resources, self.snapshots, self.stats = (Table(self, name) for name in CATALOG)

    def read(self, name: str, schema: str) -> DataFrame:
        at = f"{self.home}/{name}"
        return self.spark.read.schema(schema).parquet(at) if self.files.names(at) else self.spark.createDataFrame([], schema)

    # ---- roots ----------------------------------------------------------------------------------------------------

    def _root(self, number: int) -> Root:
        return Root(self, number, json.loads(self.files.read_bytes(f"{self.home}/{ROOTS}/{number:012d}.json")))

    def root(self) -> Root:
        """The last root; an empty one where there is none."""
        numbers = [int(n[:12]) for n in self.files.names(f"{self.home}/{ROOTS}") if n.endswith(".json")]
        return self._root(max(numbers)) if numbers else Root(self, 0, {})

    def commit(self, change: Callable[[Root], dict[str, DataFrame]]) -> Root:
        """Puts the next root, with the new rows of those tables that change gives for the last one.

        change is called again where another writer has put that root first.
        """
        for _ in range(ATTEMPTS):
            last, made = self.root(), {}
            try:
                for name, rows in change(last).items():
                    made[name] = f"v{last.number + 1}-{uuid.uuid4().hex[:12]}"
                    rows.select(*self.spark.createDataFrame([], CATALOG[name]).columns).write.parquet(f"{self.home}/{name}/{made[name]}")
                new = Root(self, last.number + 1, last.versions | made)
                won = self.files.put_new(f"{self.home}/{ROOTS}/{new.number:012d}.json", json.dumps(new.versions))
            except BaseException:
                self._drop(made)
                raise
            if won:
                self._sweep(new, last)
                return new
            self._drop(made)
        raise RuntimeError(f"other writers have won {ATTEMPTS} times")

    def _drop(self, versions: dict[str, str]) -> None:
        for name, version in versions.items():
            self.files.delete(f"{self.home}/{name}/{version}")

    def _sweep(self, new: Root, last: Root) -> None:
        """Deletes what only the root before the last one names: readers may still hold the last."""
        if not self.files.exists(f"{self.home}/{ROOTS}/{last.number - 1:012d}.json"):
            return
        old = self._root(last.number - 1)
        if old.versions.get("stats") not in (None, last.versions.get("stats")):
            keys = ["resource_id", "snapshot_id", "generation"]
            kept = new.table("stats").select(*keys).unionByName(last.table("stats").select(*keys))
            for r in old.table("stats").join(kept, keys, "left_anti").select(*keys).collect():  # those of one change
                for name in ("chunks", "postings"):
                    self.files.delete(f"{self.home}/{name}/resource_id={r['resource_id']}/snapshot_id={r['snapshot_id']}/generation={r['generation']}")
        self._drop({n: v for n, v in old.versions.items() if v not in (last.versions.get(n), new.versions.get(n))})
        self.files.delete(f"{self.home}/{ROOTS}/{old.number:012d}.json")

    # ---- facts ----------------------------------------------------------------------------------------------------

    def sign(self) -> None:
        """States the layout's version in the store, once."""
        if not self.files.exists(f"{self.home}/{SIGNATURE}"):
            self.files.write_text(f"{self.home}/{SIGNATURE}", json.dumps({"version": LAYOUT}))

    def signature(self) -> tuple[bool, bool, str | None]:
        """Whether there is a store, whether its signature can be read (a missing one can), and the version it states."""
        if not self.files.exists(self.home):
            return False, True, None
        if not self.files.exists(f"{self.home}/{SIGNATURE}"):
            return True, True, None
        try:
            return True, True, str(json.loads(self.files.read_text(f"{self.home}/{SIGNATURE}"))["version"])
        except (ValueError, KeyError, TypeError):
            return True, False, None

    def pages(self) -> DataFrame:
        return self.read("pages", PAGES)

    def chunks(self) -> DataFrame:
        return self.root().chunks()

    def postings(self) -> DataFrame:
        return self.root().postings()

    def statistics(self) -> tuple[int, int]:
        return self.root().statistics()

    def stage(self, pages: DataFrame) -> tuple[str, DataFrame]:
        """pages written once, so that fetching is not repeated; the caller drops the folder."""
        at = f"{self.home}/staging/{uuid.uuid4().hex}"
        pages.write.parquet(at)
        return at, self.spark.read.parquet(at)

    def put_pages(self, pages: DataFrame) -> None:
        """Replaces the partitions (resource_id, snapshot_id, batch) that pages has rows of."""
        pages.select(*self.spark.createDataFrame([], PAGES).columns).write.partitionBy("resource_id", "snapshot_id", "batch").options(**DYNAMIC).mode("overwrite").parquet(f"{self.home}/pages")

    def index(self, pages: DataFrame) -> DataFrame:
        """Writes the chunks and blocks of the snapshots that pages has whole, as a new generation, and gives its rows for the
        statistics (STATS); nobody reads the generation before a root names it.

        Blocks are sorted by term and range of chunks, so that a question's words are found by the statistics of row
        groups and a frequent word's blocks are dealt to many tasks; integers are delta coded.
        """
        keys, generation = ["resource_id", "snapshot_id"], uuid.uuid4().hex[:16]
        chunks = chunking.page_chunks(pages.drop("batch"))
        search = chunking.search_content(F.col("label"), F.col("url"), F.col("heading_path"), F.col("plain_text"), F.col("content"))
        vector = passage_vectors(search, self.embedder) if self.embedder else F.lit(None).cast("array<float>")
        packed = ~F.col("kind").eqNullSafe("notes")
        tokens = chunking.search_tokens(F.col("label"), F.col("url"), F.col("heading_path"), F.col("plain_text"), F.col("content"), packed)
        rows = chunks.withColumn("tokens", tokens).withColumn("n_tokens", F.size("tokens")).withColumn("embedding", vector).withColumn("generation", F.lit(generation))
        touched = pages.select(*keys).distinct().toArrow()  # the snapshots of one command or micro-batch
        self._write("chunks", rows, CHUNKS, {})
        ids = touched.column("resource_id").unique().to_pylist()
        written = self.read("chunks", CHUNKS).filter(F.col("resource_id").isin(ids) & (F.col("generation") == generation))
        blocks = inverted.invert(written).withColumn("generation", F.lit(generation)).repartitionByRange(*keys, "term", "block").sortWithinPartitions(*keys, "term", "block")
        self._write("postings", blocks, POSTINGS, inverted.DELTA)
        facts = written.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("n_tokens").cast("long").alias("tokens"))
        named = self.spark.createDataFrame(touched, "resource_id string, snapshot_id string")
        zero = F.lit(0).cast("long")
        counted = named.join(facts, keys, "left").select(*keys, F.lit(generation).alias("generation"), F.coalesce("n", zero).alias("n"), F.coalesce("tokens", zero).alias("tokens"))
        return self.spark.createDataFrame(counted.toArrow(), STATS)  # as many rows as touched has

    def _write(self, name: str, rows: DataFrame, schema: str, options: dict[str, str]) -> None:
        columns = self.spark.createDataFrame([], schema).columns
        rows.select(*columns).write.partitionBy("resource_id", "snapshot_id", "generation").options(**options).mode("append").parquet(f"{self.home}/{name}")

    def snapshot_pages(self, resource_id: str, snapshot_id: str) -> DataFrame:
        return self.pages().filter((F.col("resource_id") == resource_id) & (F.col("snapshot_id") == snapshot_id))

    def size(self, resource_id: str, snapshot_id: str) -> int:
        """Bytes of a snapshot's pages, chunks and postings."""
        return sum(self.files.size(f"{self.home}/{name}/resource_id={resource_id}/snapshot_id={snapshot_id}") for name in ("pages", "chunks", "postings"))

    def remove(self, resource_id: str, prune: bool) -> dict[str, int]:
        """Deletes a resource's catalog rows and chunks, and with prune its pages; how many there were."""
        of = F.col("resource_id") == resource_id
        root = self.root()
        counts = {"chunks": root.chunks().filter(of).count(), "snapshots": root.table("snapshots").filter(of).count(), "pages": self.pages().filter(of).count() if prune else 0}
        self.commit(lambda at: {"resources": at.table("resources").filter(F.col("id") != resource_id), "snapshots": at.table("snapshots").filter(~of), "stats": at.table("stats").filter(~of)})
        for name in ("chunks", "postings", "pages") if prune else ("chunks", "postings"):
            self.files.delete(f"{self.home}/{name}/resource_id={resource_id}")
        return counts
