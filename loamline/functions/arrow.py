"""The size of the batches that Python workers hold."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Rows of whole documents or pages a worker may hold at once.
BATCH_ROWS = 256


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lowers the session's Arrow batch size to rows, unless it is lower already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))
