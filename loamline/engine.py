"""The commands over a store and a project's manifest. Each works on single resources; pages and chunks stay tables."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import embedding, text, urls, versions
from .operators import catalog, crawl, retrieval
from .sources import fetch, files, snapshots
from .sources.registries import Arxiv, PaperRegistry
from .sources.store import LAYOUT, Root, Store, put


class Engine:
    """home holds the store; project, where given, the manifest of what the project links.

    With a manifest there, questions reach only what it links. Manifest rows never say where a resource lies: that is
    read from the catalog by id. registries: those of papers, asked in order; the first that knows a URL has it.
    """

    def __init__(self, spark: SparkSession, home: str, project: str | None = None, transport: fetch.Transport = fetch.http_get, embedder: embedding.Embedder | None = None, now: Callable[[], datetime] = lambda: datetime.now(UTC), registries: Sequence[PaperRegistry] = (Arxiv(),)):
        self.spark, self.transport, self.embedder, self._now, self.registries = spark, transport, embedder, now, registries
        self.store, self.files = Store(spark, home, embedder), files.Files(spark)
        self.manifest_path = f"{project.rstrip('/')}/loamline.json" if project else None

    # ---- manifest -------------------------------------------------------------------------------------------------

    def _manifest(self) -> dict | None:
        return files.read_manifest(self.spark, self.manifest_path) if self.manifest_path and self.files.exists(self.manifest_path) else None

    def _project(self) -> dict:
        found = self._manifest()
        if found is None:
            raise LookupError("no project manifest; call init first")
        return found

    @staticmethod
    def _named(rows: list[dict], target: str) -> dict | None:
        return next((r for r in rows if target in (r["label"], r["url"], r["id"])), None)

    def _linked(self, target: str) -> dict:
        row = self._named(self._project()["resources"], target)
        if row is None:
            raise LookupError(f"nothing is known as {target}")
        return row

    def _global(self, target: str) -> dict:
        row = catalog.find_target(self.store.resources.read(), target).first()
        if row is None:
            raise LookupError(f"nothing is known as {target}")
        return row.asDict()

    def _trusted(self, target: str) -> tuple[dict, bool]:
        """The catalog's row of a target, and whether the project links it."""
        manifest = self._manifest()
        row = self._named(manifest["resources"], target) if manifest else None
        if row is None:
            return self._global(target), False
        known = self._global(row["id"])
        return known | ({"reason": row["reason"]} if row.get("reason") is not None else {}), True

    def _put_link(self, row: dict, manifest: dict) -> None:
        """row in place of the link with its label or URL, whose time of creation stays; else as a new link."""
        for i, old in enumerate(manifest["resources"]):
            if old["label"] == row["label"] or old["url"] == row["url"]:
                manifest["resources"][i] = row | {"created_at": old["created_at"]}
                break
        else:
            manifest["resources"].append(row)
        files.write_manifest(self.spark, self.manifest_path, manifest)

    def _stamp(self) -> str:
        return self._now().strftime("%Y-%m-%dT%H:%M:%SZ")

    # ---- snapshots ------------------------------------------------------------------------------------------------

    def _fetched(self, kind: str, url: str, max_pages: int) -> tuple[DataFrame, str | None]:
        """page_index, url and content of an input, and the version of a paper."""
        if kind == "notes":
            return files.read_notes(self.spark, url).withColumn("url", F.lit(url)), None
        if kind == "docs":
            return crawl.site(self.spark, url, lambda u: fetch.fetch_pages(u, self.transport), max_pages), None
        registry = self._registry(url)
        return registry.pages(self.spark, url.removeprefix(registry.prefix), self.transport)

    def _registry(self, address: str) -> PaperRegistry:
        found = next((r for r in self.registries if address.startswith(r.prefix)), None)
        if found is None:
            raise LookupError(f"no registry for {address}")
        return found

    def _snapshot(self, row: dict, pages: DataFrame | None, max_pages: int, index: bool, force: bool) -> tuple[dict, bool, DataFrame | None]:
        """The snapshot of a resource, whether it differs from the current one, and its rows for the statistics; only where it
        differs, or by force, are its pages kept and indexed. Nothing of it is seen before it is published."""
        if not self.spark.sparkContext.getCheckpointDir():
            self.spark.sparkContext.setCheckpointDir(self.spark.sparkContext.getConf().get("spark.checkpoint.dir") or f"{self.store.home}/checkpoints")
        pages, version = self._fetched(row["kind"], row["url"], max_pages) if pages is None else (pages, None)
        staged, rows = self.store.stage(pages.select("page_index", "url", "content"))
        try:
            head = rows.withColumn("resource_id", F.lit(row["id"])).withColumn("snapshot_id", F.lit("new"))
            found = catalog.snapshot_hash(head).first()
            if found is None:
                raise ValueError(f"no pages at {row['url']}")
            at, digest = self._stamp(), found["content_hash"]
            extra = json.dumps({"registry": self._registry(row["url"]).name, "version": version}) if row["kind"] == "research_paper" else None
            snapshot = {"resource_id": row["id"], "snapshot_id": f"{at.replace(':', '').replace('-', '')}-{digest[:12]}", "kind": row["kind"], "source_url": row["url"], "content_hash": f"sha256:{digest}", "fetched_at": at, "page_count": found["page_count"], "extra": extra}
            known = self.store.snapshots.read().filter((F.col("resource_id") == row["id"]) & (F.col("snapshot_id") == F.lit(row.get("current")))).select("content_hash").first()
            changed = known is None or known["content_hash"] != snapshot["content_hash"]
            indexed = None
            if changed or force:
                kept = head.withColumn("snapshot_id", F.lit(snapshot["snapshot_id"])).withColumn("kind", F.lit(row["kind"])).withColumn("label", F.lit(row["label"])).withColumn("batch", F.lit(0).cast("long"))
                self.store.put_pages(kept)
                indexed = self.store.index(kept) if index else None
                snapshot["size_bytes"] = self.store.size(row["id"], snapshot["snapshot_id"])
        finally:
            self.files.delete(staged)
        return snapshot, changed, indexed

    def _publish(self, row: dict, snapshot: dict | None = None, indexed: DataFrame | None = None) -> None:
        """A resource's row, and its snapshot with its index, in one commit."""
        keys = ["resource_id", "snapshot_id"]

        def change(root: Root) -> dict[str, DataFrame]:
            out = {"resources": catalog.upsert(root.table("resources"), self.spark.createDataFrame([row], files.RESOURCE), ["id"], "updated_at")}
            if snapshot is not None:
                out["snapshots"] = catalog.upsert(root.table("snapshots"), self.spark.createDataFrame([snapshot], self.store.snapshots.schema), keys, "fetched_at")
            if indexed is not None:
                out["stats"] = put(root.table("stats"), indexed, keys)
            return out

        self.store.commit(change)

    # ---- commands -------------------------------------------------------------------------------------------------

    def init(self) -> str:
        """An empty manifest, unless there is one."""
        if self.manifest_path is None:
            raise ValueError("an engine without a project has no manifest")
        if self._manifest() is None:
            files.write_manifest(self.spark, self.manifest_path, {"version": 1, "defaults": {"top_k": retrieval.TOP_K, "budget_tokens": retrieval.BUDGET}, "resources": []})
        return self.manifest_path

    def add(self, url: str, label: str | None = None, reason: str | None = None, index: bool = True, max_pages: int = crawl.MAX_PAGES, pages: DataFrame | None = None, pointer: str | None = None) -> dict:
        """Snapshots, indexes and registers an input; pages (page_index, url, content) stand in for fetching it.

        A repository is registered by pointer alone: its trees are never indexed.
        """
        u = F.col("url")
        papers = [r.paper(u).alias(f"paper_{i}") for i, r in enumerate(self.registries)]
        known = self.spark.createDataFrame([(url,)], "url string").select(urls.input_kind(u).alias("kind"), urls.default_name(u).alias("label"), F.regexp_extract(urls.path(u), "^/([^/]+/[^/]+)", 1).alias("repository"), *papers).first()
        paper = next(((r, known[f"paper_{i}"]) for i, r in enumerate(self.registries) if known[f"paper_{i}"]), None)
        kind = "research_paper" if paper else known["kind"]
        if kind is None or (kind == "research_paper" and not paper):
            raise ValueError(f"not an input: {url}")
        label = label or (f"{paper[0].name}-{paper[1].replace('/', '-')}" if paper else known["label"])
        where = paper[0].prefix + paper[1] if paper else url
        named = {"source": f"source:https://github.com/{known['repository'].removesuffix('.git')}.git:{label}", "research_paper": f"research-paper:{paper[0].name if paper else ''}:{where}:{label}"}.get(kind, f"{kind}:{where}:{label}")
        ident = self.spark.range(1).select(text.stable_id(F.lit(named)).alias("id")).first()["id"]
        row = {"id": ident, "label": label, "kind": kind, "url": where, "reason": reason, "current": pointer, "created_at": self._stamp(), "updated_at": self._stamp()}
        snapshot, indexed = None, None
        if kind != "source":
            snapshot, _, indexed = self._snapshot(row, pages, max_pages, index, True)
            row["current"] = snapshot["snapshot_id"]
        elif pointer is None:
            raise ValueError("a repository is added by its pointer")
        self._publish(row, snapshot, indexed)
        self.store.sign()
        return row

    def update(self, target: str, force: bool = False, max_pages: int = crawl.MAX_PAGES, pages: DataFrame | None = None) -> dict:
        """A new snapshot, kept where it differs from the current one, or by force; repositories stay as pinned."""
        row, linked = self._trusted(target)
        if row["kind"] == "source":
            return {"changed": False, "resource": row, "message": "repositories stay at their pointer; add the resource with another one to move it"}
        snapshot, changed, indexed = self._snapshot(row, pages, max_pages, True, force)
        if changed or force:
            row = row | {"current": snapshot["snapshot_id"], "updated_at": self._stamp()}
            self._publish(row, snapshot, indexed)
            if linked:
                self._put_link(row, self._project())
        return {"changed": changed, "resource": row, "snapshot": snapshot}

    def sync(self, reindex: bool = False) -> DataFrame:
        """label, kind, ready, rehydrated and message of each link; with reindex its current snapshot is indexed anew."""
        out = []
        for link in self._project()["resources"]:
            row = catalog.find_target(self.store.resources.read(), link["id"]).first()
            ready, message = False, None
            if row is None:
                message = "a manifest alone rebuilds nothing; add or update the resource here"
            elif row["kind"] == "source":
                ready = row["current"] is not None
            else:
                pages = self.store.snapshot_pages(row["id"], row["current"])
                ready = not pages.isEmpty()
                if ready and reindex:
                    indexed = self.store.index(pages)
                    self.store.commit(lambda root, new=indexed: {"stats": put(root.table("stats"), new, ["resource_id", "snapshot_id"])})
            out.append((link["label"], link["kind"], ready, False, message))
        return self.spark.createDataFrame(out, "label string, kind string, ready boolean, rehydrated boolean, message string")

    def query(self, question: str, top_k: int = retrieval.TOP_K, budget: int = retrieval.BUDGET, label: str | None = None, kind: str | None = None, debug: bool = False, scope: str = "post_limit", snapshots: str = "all", nested: bool = False) -> DataFrame:
        """Evidence for a question, a row for each chunk, or for each group with nested.

        scope: whether lexical hits are narrowed after the candidate limit (post_limit) or before (pre_limit).
        snapshots: all of them, or the current ones. An unknown label is an error; a kind without resources is not.
        """
        manifest, root = self._manifest(), self.store.root()
        rows = root.table("resources")
        if manifest is not None:
            rows = self.spark.createDataFrame([{k: r.get(k) for k in rows.columns} for r in manifest["resources"]], files.RESOURCE)
        allowed = catalog.queryable(rows, label, kind)
        if label is not None and allowed.isEmpty():
            raise LookupError(f"nothing that can be queried is labelled {label}")
        chunks, index, current = root.chunks(), root.postings(), None
        if snapshots == "current":
            current = rows.select(F.col("id").alias("resource_id"), F.col("current").alias("snapshot_id"))
            chunks, index = (df.join(current, ["resource_id", "snapshot_id"], "left_semi") for df in (chunks, index))
        terms, phrases = retrieval.read_question(question, self.spark)
        vector = embedding.query_vector(question, self.embedder) if self.embedder else None
        found = retrieval.search(chunks, terms, phrases, vector, allowed.select(F.col("id").alias("resource_id")), top_k, budget, scope == "pre_limit", debug, index, root.statistics(current))
        return retrieval.results(found) if nested else found

    def show(self, target: str | None = None) -> DataFrame:
        """The project's links, or the catalog where there is no manifest; or the one target."""
        manifest = self._manifest()
        rows = self.store.resources.read()
        if target is None and manifest is None:
            return rows
        found = manifest["resources"] if target is None else [(self._named(manifest["resources"], target) if manifest else None) or self._global(target)]
        return self.spark.createDataFrame([{k: r.get(k) for k in rows.columns} for r in found], files.RESOURCE)

    def history(self, target: str | None = None) -> DataFrame:
        return catalog.history(self.show(target), self.store.snapshots.read())

    def list(self, project_only: bool = False, kind: str | None = None) -> DataFrame:
        """The catalog with the facts of current snapshots, size_bytes of all of them as they were written, and whether the
        project links each resource."""
        root = self.store.root()
        rows = root.table("resources")
        rows = rows if kind is None else rows.filter(F.col("kind") == kind)
        ids = [(r["id"],) for r in (self._manifest() or {"resources": []})["resources"]]
        out = catalog.linked(catalog.listing(rows, root.table("snapshots")), self.spark.createDataFrame(ids, "id string"), project_only)
        sizes = root.table("snapshots").groupBy(F.col("resource_id").alias("id")).agg(F.sum("size_bytes").alias("size_bytes"))
        return out.join(sizes, "id", "left").orderBy("kind", "label", "id")

    def path(self, target: str) -> str:
        """Where a repository's pointer lies in the store; the engine keeps no checkouts itself."""
        row, _ = self._trusted(target)
        if row["kind"] != "source":
            raise ValueError("only source resources have a path")
        return f"{self.store.home}/sources/{row['id']}/{row['current']}"

    def link(self, target: str, reason: str | None = None) -> dict:
        manifest, row = self._project(), self._global(target)
        row = row if reason is None else row | {"reason": reason}
        self._put_link(row, manifest)
        return row

    def unlink(self, target: str) -> dict:
        manifest, row = self._project(), self._linked(target)
        manifest["resources"] = [r for r in manifest["resources"] if target not in (r["label"], r["url"], r["id"])]
        files.write_manifest(self.spark, self.manifest_path, manifest)
        return row

    def use(self, target: str, pointer: str) -> dict:
        """Moves a link to another snapshot of its resource; a repository's link only to where it is."""
        manifest = self._project()
        row = self._named(manifest["resources"], target)
        if row is None:
            raise LookupError(f"nothing is known as {target}")
        known = self.store.snapshots.read().filter((F.col("resource_id") == row["id"]) & (F.col("snapshot_id") == pointer))
        if (row["kind"] == "source" and pointer != row["current"]) or (row["kind"] != "source" and known.isEmpty()):
            raise LookupError(f"{target} has no snapshot {pointer}")
        row |= {"current": pointer, "updated_at": self._stamp()}
        files.write_manifest(self.spark, self.manifest_path, manifest)
        return row

    def remove(self, target: str, prune: bool = False) -> dict[str, int]:
        return self.store.remove(self._global(target)["id"], prune)

    def export(self, target: str, folder: str) -> dict:
        """Writes a resource's current snapshot as files below folder; the snapshot's record."""
        row, _ = self._trusted(target)
        known = self.store.snapshots.read().filter((F.col("resource_id") == row["id"]) & (F.col("snapshot_id") == F.lit(row["current"]))).first()
        if known is None:
            raise LookupError(f"{target} has no snapshot to export")
        extra = json.loads(known["extra"]) if known["extra"] else None
        return snapshots.write_snapshot(self.store.snapshot_pages(row["id"], row["current"]), folder, row["kind"], row["id"], known["source_url"], known["fetched_at"], extra)

    def doctor(self) -> dict:
        """What is there, the layout's version against this library's, and what is wrong: numbers of resources without
        their current snapshot, of snapshots without pages, and of indexed snapshots without postings."""
        manifest = self._manifest()
        signed, readable, version = self.store.signature()
        status = self.spark.range(1).select(versions.installed_status(F.lit(signed), F.lit(readable), F.lit(version).cast("string"), F.lit(LAYOUT)).alias("s")).first()["s"]
        root = self.store.root()
        resources, known = root.table("resources"), root.table("snapshots")
        at = ["resource_id", "snapshot_id"]
        current = resources.filter("kind <> 'source'").select(F.col("id").alias("resource_id"), F.col("current").alias("snapshot_id"))
        problems = {
            "resources_without_snapshot": current.join(known, at, "left_anti").count(),
            "snapshots_without_pages": known.filter("page_count > 0").join(self.store.pages().select(*at), at, "left_anti").count(),
            "snapshots_without_postings": root.chunks().filter("n_tokens > 0").select(*at).distinct().join(root.postings().select(*at), at, "left_anti").count(),
        }
        return {
            "home": self.store.home,
            "manifest_exists": manifest is not None,
            "project_resources": len(manifest["resources"]) if manifest else 0,
            "resources": resources.count(),
            "snapshots": known.count(),
            "chunks": root.chunks().count(),
            "layout": {"version": version, "running": LAYOUT, "status": status},
            "problems": problems,
            "healthy": status == versions.CURRENT and not any(problems.values()),
        }
