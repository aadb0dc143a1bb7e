"""Sinks: partitioned tables with upsert, run files, predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(current: DataFrame, fresh: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of fresh, and those of current whose key isn't in fresh."""
    return current.join(fresh.select(key).distinct(), key, "left_anti").select(*current.columns).unionByName(fresh.select(*current.columns))


def missing(wanted: DataFrame, done: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows that are still to be made."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")


def bucket_of(key: Column, each: int = 1000) -> Column:
    """Partition of a document in a phrase table."""
    return F.floor(key / each).cast("long")


def write_phrases(phrases: DataFrame, path: str, each: int = 1000) -> None:
    """Phrase table by ranges of documents; only the ranges that are written are replaced."""
    made = phrases.withColumn("bucket", bucket_of(F.col("doc_id"), each)).repartition("bucket")
    made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def write_postings(postings: DataFrame, path: str, ngram: int = 2, size: int | None = None) -> None:
    """Postings and, beside them, a row with their parameters."""
    postings.write.mode("overwrite").parquet(f"{path}/postings")
    spark = postings.sparkSession
    spark.createDataFrame(
        [(ngram, size, "simple")], "ngram int, hash_size long, tokenizer string",
    ).write.mode("overwrite").parquet(f"{path}/parameters")


def write_paragraphs(weights: DataFrame, path: str, each: int = 1000) -> None:
    """Paragraph weights (doc_id, par_idx, term, weight). Paragraphs that are in weights replace those of the table; the others of the same ranges stay."""
    spark = weights.sparkSession
    fresh = weights.withColumn("bucket", bucket_of(F.col("doc_id"), each))
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        old = spark.read.parquet(path).join(fresh.select("bucket").distinct(), "bucket", "left_semi")
        kept = old.join(fresh.select("doc_id", "par_idx").distinct(), ["doc_id", "par_idx"], "left_anti")
        staged = f"{path}-staged"
        fresh.unionByName(kept.select(*fresh.columns)).write.mode("overwrite").parquet(staged)
        fresh = spark.read.parquet(staged)
    fresh.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def prediction_rows(scored: DataFrame, top_k: int) -> DataFrame:
    """Scored predictions (qid, em_top1, em_topk, f1_top1, f1_topk) with the names of the prediction files."""
    names = {"em_topk": f"em_top{top_k}", "f1_topk": f"f1_top{top_k}"}
    flags = [F.col(c).cast("boolean").alias(names.get(c, c)) for c in ("em_top1", "em_topk")]
    return scored.select("qid", *flags, *[F.col(c).alias(names.get(c, c)) for c in ("f1_top1", "f1_topk")])


def sentence_rows(scored: DataFrame) -> DataFrame:
    """Sentence metrics with precision and reciprocal rank as text of three places."""
    return scored.select("qid", F.col("recall_1").cast("boolean").alias("recall_1"), F.col("recall_k").cast("boolean").alias("recall_k"),
                         F.format_string("%.3f", F.col("precision_50")).alias("prec_k"), F.format_string("%.3f", F.col("mrr")).alias("mrr_k"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("line").write.mode("overwrite").text(path)


def write_predictions(predictions: DataFrame, path: str) -> None:
    predictions.write.mode("overwrite").json(path)


def responses(answers: DataFrame) -> DataFrame:
    """qid and the answers as one JSON document, by rank; a question has at most top_k of them."""
    other = [c for c in answers.columns if c not in ("qid", "rank")]
    listed = answers.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", *other))).alias("ret"))
    return listed.select("qid", F.to_json(F.struct("ret")).alias("response"))
