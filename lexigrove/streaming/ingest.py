"""Corpus files as a stream: term counts are kept up to date by document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lexigrove.operators.tfidf import term_counts
from lexigrove.sources.writers import bucket_of
from pyspark.sql import functions as F

DOCUMENT = "doc_id long, text string"


def watch(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of Parquet files that appear in the folder."""
    return spark.readStream.schema(DOCUMENT).parquet(folder)


def keep_counts(stream: DataFrame, path: str, checkpoint: str, each: int = 1000) -> StreamingQuery:
    """Term counts by batch and range of documents. A batch that runs again replaces its own files; current_counts() reads the newest of each document."""

    def write(batch: DataFrame, number: int) -> None:
        made = term_counts(batch.dropDuplicates(["doc_id"])).withColumn("bucket", bucket_of(F.col("doc_id"), each)).withColumn("batch", F.lit(number))
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "bucket").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_counts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, term, tf of each document's newest batch."""
    every = spark.read.parquet(path)
    newest = every.groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return every.join(newest, ["doc_id", "batch"]).select("doc_id", "term", "tf")
