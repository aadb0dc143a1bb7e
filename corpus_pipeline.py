"""Documents to packed training sequences: five stages, each over all that the one before kept.

STAGES lists (name, function); each function takes (spark, docs, sf_dir). All but the last return the
columns of documents; n_chars follows the text. Rows are handled alone as the operators
state: null texts stay null, rows without words stay, repeated rows of one id are one
document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.llm import jaccard_join, packing, secret_scan, suffix_dedup, toxicity
from lexigrove.llm.queries import tokenizer_path
from lexigrove.llm.shared import table
from lexigrove.sources.readers import spread

#: Documents with at least this score are rejected.
TOXIC = 0.7


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores below TOXIC."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    machine = toxicity.fit(docs, labels.filter(~toxicity.held_out(F.col("doc_id"))))
    scored = toxicity.score(docs, machine, keep=tuple(docs.columns), name="_toxicity")
    return scored.filter(F.col("_toxicity") < TOXIC).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of least id."""
    return jaccard_join.one_of_each(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of long repeated strings."""
    return _sized(suffix_dedup.without_repeats(docs))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark for each secret."""
    return _sized(secret_scan.redact(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", not_toxic),
    ("ngram_jaccard_join", one_of_each),
    ("suffix_array_dedup", without_repeats),
    ("secret_scans", without_secrets),
    ("packing", packed),
]

#: SQL can express neither the trained scores nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
