"""Arrow batches of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of an Arrow batch at most, so that what a worker holds doesn't depend on the texts' lengths or the table's size.
ROWS, BYTES = 10_000, 4 << 20


def limit(spark: SparkSession, rows: int = ROWS) -> None:
    """Lower the session's limits of a batch, never raise them."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", BYTES)):
        now = spark.conf.get(key).rstrip("b")  # sizes are shown in bytes
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def bounded(frame: DataFrame, rows: int = ROWS) -> DataFrame:
    """The frame, whose session has bounded batches from now on."""
    limit(frame.sparkSession, rows)
    return frame
