"""Encoders as plug-ins: functions from texts to vectors, run over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Tokenizer(Protocol):
    """What turns a text column into an array of words."""

    def __call__(self, text: Column) -> Column: ...


def encoded(rows: DataFrame, encoder: Callable[[list[str]], np.ndarray], text: str = "text", name: str = "vector") -> DataFrame:
    """rows with the encoder's vector of each text (null: empty). The encoder is shipped to the workers and called batch by batch."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            made = np.asarray(encoder([t or "" for t in texts]), np.float64)
            yield pd.Series(list(made))

    return rows.withColumn(name, F.pandas_udf(run, "array<double>")(F.col(text).cast("string")))


def phrase_vectors(vector: Column, span_size: int) -> Column:
    """Struct (start, end, span) of an encoder's output: the last span_size numbers are of the span, what is left is halved."""
    half = F.floor((F.size(vector) - span_size) / 2).cast("int")
    return F.struct(
        F.slice(vector, F.lit(1), half).alias("start"), F.slice(vector, half + 1, half).alias("end"), F.slice(vector, F.size(vector) - span_size + 1, span_size).alias("span")
    )


def sparse_weights(query: np.ndarray, key: np.ndarray, ids: np.ndarray, first_text_id: int = 999) -> np.ndarray:
    """Weight of each token for each start: positive parts of scaled products, none for itself or special tokens."""
    out = np.maximum(query @ key.T / np.sqrt(query.shape[1]), 0.0)
    out[:, ids < first_text_id] = 0.0
    np.fill_diagonal(out, 0.0)
    return out


def query_vectors(questions: DataFrame, vectors: DataFrame, text: str = "question") -> DataFrame:
    """Questions with the vectors that are known for their texts; those without stay, with null."""
    return questions.join(vectors, text, "left")
