"""Files that a store, a project or a harness reads and writes, by paths that Spark's readers know."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE = "array<struct<url:string,content:string>>"
RESOURCE = "id string, label string, kind string, url string, reason string, current string, created_at string, updated_at string"


class Files:
    """Folders and small files on any file system that Hadoop knows."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._fs = spark._jvm.org.apache.hadoop.fs

    def _at(self, path: str):
        p = self._fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.exists(p)

    def delete(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.delete(p, True)

    def rename(self, path: str, to: str) -> bool:
        p, fs = self._at(path)
        return fs.rename(p, self._fs.Path(to))

    def names(self, path: str) -> list[str]:
        p, fs = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def size(self, path: str) -> int:
        """Bytes of all files below path; 0 if there is none."""
        p, fs = self._at(path)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0

    def read_text(self, path: str) -> str:
        return self.spark.read.text(path, wholetext=True).first()["value"]

    def read_bytes(self, path: str) -> bytes:
        """A small file, read where the driver is; no job is run for it."""
        p, fs = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def _written(self, path: str, text: str, replace: bool) -> None:
        """Writes text beside path and renames it into place."""
        new = f"{path}.{uuid.uuid4().hex}.tmp"
        p, fs = self._at(new)
        out = fs.create(p, True)
        out.write(bytearray(text.encode()))
        out.close()
        renames = getattr(self._fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(renames, 1)
        how[0] = renames.OVERWRITE if replace else renames.NONE
        try:
            self._fs.FileContext.getFileContext(p.toUri() if p.toUri().getScheme() else fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(p, self._fs.Path(path), how)
        except BaseException:
            fs.delete(p, False)
            raise

    def write_text(self, path: str, text: str) -> None:
        """Replaces path by one rename, so readers see the old text or the new one."""
        self._written(path, text, True)

    def put_new(self, path: str, text: str) -> bool:
        """Puts a file where none is, whole, and says whether it did: false where one was there first."""
        try:
            self._written(path, text, False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True


def read_notes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """page_index, url and content of whole files, each a page of its own."""
    return spark.read.text(paths, wholetext=True).select(F.lit(0).cast("long").alias("page_index"), F.input_file_name().alias("url"), F.col("value").alias("content"))


def read_snapshot(spark: SparkSession, folder: str, source_url: str) -> DataFrame:
    """The pages of a snapshot folder: pages.json, or content.txt as its one page."""
    if Files(spark).exists(f"{folder}/pages.json"):
        pages = F.from_json("value", PAGE)
        return spark.read.text(f"{folder}/pages.json", wholetext=True).select(F.posexplode(pages).alias("page_index", "page")).select(F.col("page_index").cast("long"), "page.url", "page.content")
    return spark.read.text(f"{folder}/content.txt", wholetext=True).select(F.lit(0).cast("long").alias("page_index"), F.lit(source_url).alias("url"), F.col("value").alias("content"))


def snapshot_facts(metadata: Column) -> Column:
    """What a snapshot's metadata keeps under extra, as a variant; null where there is none or the text is no JSON."""
    return F.try_variant_get(F.try_parse_json(metadata), "$.extra", "variant")


def fact(variant: str, path: str, kind: str) -> Column:
    """One value of a variant column as a kind of column; null where it isn't there or is of another kind."""
    return F.try_variant_get(F.col(variant), path, kind)


def snapshot_extra(metadata: Column, field: str) -> Column:
    return F.try_variant_get(F.try_parse_json(metadata), f"$.extra.{field}", "string")


def heading_path_of(encoded: Column) -> Column:
    """A heading path from its JSON form; an empty one from anything else."""
    return F.coalesce(F.from_json(encoded, "array<string>"), F.array().cast("array<string>"))


def heading_path_json(path: Column) -> Column:
    return F.to_json(path)


def read_cases(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Benchmark cases, one JSON object a line, blank lines skipped; the first few where a limit is given."""
    texts = ["id", "library", "label", "doc_path", "source_url", "question", "llms_summary", "doc_text"]
    cases = spark.read.schema(", ".join(f"{c} string" for c in texts) + ", must_include array<string>").json(path).filter("id IS NOT NULL")
    return cases if limit is None else cases.limit(limit)


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(Files(spark).read_text(path))


def write_manifest(spark: SparkSession, path: str, manifest: dict) -> None:
    """Pretty JSON without local paths."""
    rows = [{k: v for k, v in r.items() if k != "local_path"} for r in manifest["resources"]]
    Files(spark).write_text(path, json.dumps(manifest | {"resources": rows}, indent=2, ensure_ascii=False))
