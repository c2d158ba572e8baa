"""Token counts as delta-maintained rollups.

A rollup holds additive totals (documents, tokens) by source, language and tokenizer version. Batches of changes come
as inserts, deletes and revisions; a batch is summed into signed deltas by key before anything is shuffled, written
beside the others, and made visible by one marker file, written whole and then renamed to a name that only one writer can
take. Compactions have a folder of their own, so no batch id is taken for one; each covers what came after the last.
A batch id that has been committed is never applied again, and a writer that dies before the rename leaves nothing
that counts, so a failed or repeated run may be replayed at will. (Local file systems check the name before they rename,
so there two writers at the very same moment are not kept apart; stores with atomic renames do so.)
"""

from __future__ import annotations

import json
import uuid
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import bounded_batches, default_tokenizer, encoder

KEYS = ("source", "lang", "tokenizer")
CHANGES = "op string, source string, lang string, tokenizer string, tokens long, old_source string, old_lang string, old_tokenizer string, old_tokens long"


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the columns in keep, n_bytes and tokens (long) of each whole text. A null or empty text has 0 tokens.

    Null ids and repeated rows are counted like any other, an empty table gives an empty one. A column of keep that is
    named n_bytes or tokens, whatever its case, is left out.
    """
    path = tokenizer_path or default_tokenizer()
    bounded_batches(docs.sparkSession)
    given = docs.select(F.col(f"`{id_col}`"), *[F.col(f"`{c}`") for c in keep if c.lower() not in ("n_bytes", "tokens")], F.col(f"`{text_col}`"))
    n = len(given.columns) - 1

    def count(batches):
        of = encoder(path).ids
        for b in batches:
            texts = b.column(n).to_pylist()
            sizes = pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:n], sizes, pa.array([len(of(t)) for t in texts], pa.int64())], [*b.schema.names[:n], "n_bytes", "tokens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:n])
    return given.mapInArrow(count, f"{schema}, n_bytes long, tokens long")


def signed(changes: DataFrame) -> DataFrame:
    """Signed rows (source, lang, tokenizer, docs, tokens) of change rows (the columns of CHANGES; more are ignored).

    insert adds the new side, delete takes the old side away, revise does both. A null count is 0; null keys are keys
    of their own; a repeated row counts again, as a batch is a bag. Any other op fails the batch.
    """
    side = lambda sign, old: F.struct(*[F.col(old + k).alias(k) for k in KEYS], F.lit(sign).cast("long").alias("docs"), (sign * F.coalesce(F.col(old + "tokens"), F.lit(0))).cast("long").alias("tokens"))
    new, old = side(1, ""), side(-1, "old_")
    sides = F.when(F.col("op") == "insert", F.array(new)).when(F.col("op") == "delete", F.array(old)).when(F.col("op") == "revise", F.array(old, new))
    return changes.select(F.explode(sides.otherwise(F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce("op", F.lit("null")))).cast("array<struct<source:string,lang:string,tokenizer:string,docs:bigint,tokens:bigint>>"))).alias("s")).select("s.*")


class TokenRollup:
    """A rollup in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _json(self, folder: str, names: list[str]) -> list[dict]:
        found = []
        for name in names:
            at, fs = self._fs(f"{self.path}/{folder}/{name}")
            stream = fs.open(at)
            try:
                found.append(json.loads(bytes(stream.readAllBytes()).decode()))
            finally:
                stream.close()
        return found

    def _names(self, folder: str) -> list[str]:
        at, fs = self._fs(f"{self.path}/{folder}")
        return sorted(status.getPath().getName() for status in fs.listStatus(at)) if fs.exists(at) else []

    def _state(self) -> tuple[list[str], list[dict]]:
        """The names of all committed batches, listed but not opened, and the compactions in order."""
        compactions = self._json("compactions", self._names("compactions"))  # listed first: what they cover is committed
        return self._names("commits"), compactions

    def batches(self) -> list[str]:
        return sorted(map(unquote, self._names("commits")))

    def _commit(self, folder: str, name: str, rows: DataFrame, facts: dict) -> bool:
        """Writes rows, then a marker of this name; False if another writer has taken the name."""
        data = f"{self.path}/deltas/{folder}-{name}/{uuid.uuid4().hex}"
        rows.write.parquet(data)
        marker, fs = self._fs(f"{self.path}/{folder}/{name}")
        pending, _ = self._fs(f"{self.path}/pending/{uuid.uuid4().hex}")
        stream = fs.create(pending, False)
        try:
            stream.write(bytearray((json.dumps(facts | {"data": data}) + "\n").encode()))
        finally:
            stream.close()
        fs.mkdirs(marker.getParent())
        sc = self.spark.sparkContext
        jvm = sc._jvm
        never_over = sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        never_over[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration()).rename(pending, marker, never_over)
        except Exception:
            fs.delete(pending, False)
            if not fs.exists(marker):
                raise
            fs.delete(self._fs(data)[0], True)  # another writer has been first
            return False
        return True

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commits a batch of changes; False if this batch id has been committed before. An empty batch is committed."""
        marker, fs = self._fs(f"{self.path}/commits/{quote(batch, safe='')}")
        if fs.exists(marker):
            return False
        deltas = signed(changes).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return self._commit("commits", quote(batch, safe=""), deltas.filter("docs <> 0 OR tokens <> 0"), {"batch": batch})

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens over all committed batches. Keys that sum to nothing are left out."""
        return self._summed(*self._state())

    def _summed(self, names: list[str], compactions: list[dict]) -> DataFrame:
        covered = {name for c in compactions for name in c["covers"]}
        paths = [c["data"] for c in compactions[-1:]] + [m["data"] for m in self._json("commits", [n for n in names if n not in covered])]
        schema = "source string, lang string, tokenizer string, docs long, tokens long"
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs <> 0 OR tokens <> 0")

    def compact(self) -> bool:
        """Sums the last compaction and the batches since then; False if another compaction has been first.

        A compaction names only the batches it adds. Their markers stay, as they are what keeps a replay from counting.
        """
        names, compactions = self._state()  # read once: a batch committed meanwhile is neither summed nor covered
        covered = {name for c in compactions for name in c["covers"]}
        return self._commit("compactions", f"{len(compactions):09d}", self._summed(names, compactions), {"covers": [n for n in names if n not in covered]})
