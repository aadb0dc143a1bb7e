"""Tables in the folder that driver and executors share; Arrow functions with bounded memory."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of an Arrow batch at most, so that what a worker holds doesn't depend on the texts' lengths.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
Rows = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def give_back() -> None:
    """Return what this process has freed to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _given_back(run: Rows) -> Rows:
    """run, after which the worker returns what it has freed: workers are used again by other stages."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def arrow(frame: DataFrame, run: Rows, schema: str) -> DataFrame:
    """mapInArrow over batches of bounded size. Lowers the session's limits of a batch, never raises them."""
    conf = frame.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(key).rstrip("b")  # sizes are shown in bytes
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(key, str(most))
    return frame.mapInArrow(_given_back(run), schema)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's checkpoint folder; local sessions without either use a folder of their own machine."""
    given = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not given:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        given = known.get() if known.isDefined() else ""
    if not given:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        given = "/tmp/checkpoints"
    return given.rstrip("/")


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What runs here leaves no shuffle files; else they stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def table(frame: DataFrame, name: str) -> DataFrame:
    """The frame written once to the shared folder and read again: cuts lineage and outlives executors."""
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def drop_table(frame: DataFrame) -> None:
    """Remove a table made by table(), when nothing reads it any more."""
    spark = frame.sparkSession
    for file in frame.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
