"""Token windows, running offsets, sentences and paragraphs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrove.functions.arrays import empty, let, scanned
from lexigrove.operators import counting


def _window_count(n: Column, length: int, stride: int) -> Column:
    return F.when(n <= length, F.lit(1)).otherwise(1 + F.ceil((n - length) / stride).cast("int"))


def window_bounds(n: Column, length: int, stride: int) -> Column:
    """Array of (window, start, stop) that cover n tokens; strides stop with the window that reaches the end."""
    stride = min(length, stride)

    def of(n: Column) -> Column:
        def window(i: Column) -> Column:
            return F.struct(i.alias("window"), (i * stride).alias("start"), F.least(i * stride + length, n).alias("stop"))

        made = F.transform(F.sequence(F.lit(0), _window_count(n, length, stride) - 1), window)
        return F.when(n > 0, made).otherwise(empty("array<struct<window:int,start:int,stop:int>>"))

    return let(n, of)


def token_windows(docs: DataFrame, n: Column, length: int = 64, stride: int = 32) -> DataFrame:
    return docs.select("doc_id", F.explode(window_bounds(n, length, stride)).alias("w")).select("doc_id", "w.*")


def best_window(n: Column, length: int, stride: int) -> Column:
    """For each token the window with most context: least of both sides, and a hundredth of the length; the first of equal ones.

    Only the windows that hold a token are looked at; their numbers follow from the token's place.
    """
    stride = min(length, stride)

    def windows(n: int) -> np.ndarray:
        p = np.arange(n)
        last = 0 if n <= length else -(-(n - length) // stride)
        i = np.maximum(0, (p - length) // stride + 1)
        best, most = i, np.full(n, -np.inf)
        while len(p):
            there = (i <= last) & (i * stride <= p)
            if not there.any():
                break
            stop = np.minimum(i * stride + length, n)
            context = np.minimum(p - i * stride, stop - 1 - p) + 0.01 * (stop - i * stride)
            better = there & (context > most)
            best, most, i = np.where(better, i, best), np.where(better, context, most), i + 1
        return best.astype(np.int32)

    @F.pandas_udf("array<int>")
    def of(sizes: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(n) else windows(int(n)) for n in sizes], dtype=object)

    return of(n)


def word_offsets(docs: DataFrame) -> DataFrame:
    """doc_id, word and start of the words between white space, in the task that has the text."""
    return counting.words_between(docs).select("doc_id", "word", "start")


def sentences(text: Column, delimiter: str = "\n") -> Column:
    """Half-open bounds of the parts between delimiters; each part ends with its delimiter."""
    lengths = F.transform(F.split(text, delimiter), lambda p: F.length(p) + 1)
    return scanned(
        lengths, F.lit(0), "array<struct<start:int,stop:int>>",
        lambda at, n: (at + n, F.struct(at.alias("start"), (at + n).alias("stop"))),
    )


def sentence_at(bounds: Column, position: Column, n: Column) -> Column:
    """Struct (sent_start, sent_end, c_start, c_end): the sentence of a position, and the context from the former sentence to the next one, within n characters."""

    def of(all_of: Column) -> Column:
        i = F.size(F.filter(all_of, lambda x: x["start"] <= position)) - 1
        own, before, after = F.get(all_of, i), F.get(all_of, i - 1), F.get(all_of, i + 1)
        first = F.when(i > 0, before["start"]).otherwise(own["start"])
        clamp = lambda c: F.least(c, n).cast("long")
        return F.struct(
            own["start"].cast("long").alias("sent_start"), clamp(own["stop"]).alias("sent_end"),
            first.cast("long").alias("c_start"), clamp(F.coalesce(after["stop"], own["stop"])).alias("c_end"),
        )

    return let(bounds, of)


def localize(docs: DataFrame, position: Column) -> DataFrame:
    """doc_id, start_pos, its sentence's bounds, and the context from the former sentence to the next one. No shuffle."""
    rows = docs.select(
        "doc_id", position.cast("long").alias("start_pos"),
        sentence_at(sentences(F.col("text")), position, F.length("text")).alias("s"),
    )
    return rows.select("doc_id", "start_pos", "s.*")


def enclosing_segment(text: Column, start: Column, end: Column, delimiter: str = " [PAR] ") -> Column:
    """(segment, start, end): the part between delimiters around start, and the positions within it."""
    head = F.substring(text, F.lit(1), start)
    back = F.locate(delimiter[::-1], F.reverse(head))
    low = F.when(back > 0, F.length(head) - back + 1).otherwise(F.lit(0))
    after = F.locate(delimiter, F.substring(text, start + 1, F.length(text)))
    high = F.when(after > 0, start + after - 1).otherwise(F.length(text))
    return F.struct(
        F.substring(text, low + 1, high - low).alias("segment"), (start - low).cast("long").alias("start_pos"),
        (end - low).cast("long").alias("end_pos"),
    )
