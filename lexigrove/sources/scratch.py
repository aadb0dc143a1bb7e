"""Folders that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir or the context's checkpoint folder; without either only local sessions have one."""
    given = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not given:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        given = known.get() if known.isDefined() else ""
    if not given and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(given or '/tmp/checkpoints').rstrip('/')}/{name}-{uuid.uuid4().hex}"
