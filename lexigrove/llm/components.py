"""Connected components by alternating large and small stars over DataFrames.

A first step replaces the edges of each task by a star forest. Each round then takes minima
of neighbours, which combine before the shuffle; rounds end when the edges no longer change.
As soon as no more than ONE_TASK edges are left, one task finishes them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow, drop_table, table


#: Edges that one task holds (16 bytes each).
ONE_TASK = 1 << 20


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the least of its component, without the least itself."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    root = np.arange(len(nodes))
    left, right = at[: len(a)], at[len(a) :]
    while True:
        x, y = root[left], root[right]
        different = x != y
        if not different.any():
            break
        left, right, x, y = left[different], right[different], x[different], y[different]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(root, root[root]):
            root = root[root]
    keep = root != np.arange(len(nodes))
    return nodes[keep], nodes[root[keep]]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [np.zeros(0, np.int64)] * 2
    for batch in batches:
        held = list(forest(*(np.r_[h, c.to_numpy()] for h, c in zip(held, batch.columns))))
        if len(held[0]) > 1 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(h) for h in held], ["a", "b"])
            held = [np.zeros(0, np.int64)] * 2
    if len(held[0]):
        yield pa.RecordBatch.from_arrays([pa.array(h) for h in held], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """node and component (its least node) of every node with an edge (a, b), both long; null ends are no edges."""
    edges = arrow(edges.filter("a <> b"), _forests, "a long, b long")
    current, last = table(edges, "edges"), None
    while True:
        if current.limit(ONE_TASK + 1).count() <= ONE_TASK:
            whole = arrow(current.coalesce(1), _forests, "a long, b long")
            nodes = whole.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return nodes.union(nodes.select("component", "component").distinct())
        both = current.union(current.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(
            F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
        )).alias("e")).select("e.*")
        following = table(small.filter("a <> b").distinct(), "edges")
        drop_table(current)
        current = following
        now = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    nodes = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(current.select("b", "b").distinct())
