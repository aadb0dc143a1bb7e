"""Near-duplicate vectors by cross-polytope hashing.

A hash is the coordinate of largest size, with its sign, after three rounds of random signs and a
fast Hadamard transform. Of each of TABLES tables, FUNCTIONS hashes together name a bucket;
as many as keep buckets near BUCKET vectors at the given number. Multiprobe: a vector
goes to the buckets of its two largest coordinates in each function. Of vectors at cosine 0.98 in 64
dimensions, two share a bucket of a table with probability 0.97 for each function.

All pairs in a bucket are verified by matrix products in double precision, in blocks: larger
buckets are dealt out as pairs of blocks. A pair counts in the least of its common buckets
alone, so no pairs are shuffled: tasks return counts of links and the edges of a star forest.
Equal vectors of one label collapse before and count by their number.

Vectors link only with those of their label and number of components. Without a label, or if
null, zero, or with null or non-finite components, they link with nothing. Ids may repeat or
be null; rows count each, and components take the least id there is. Labels are of any type that is written as text.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, forest
from .shared import arrow, table, width
from .textwords import mix

TABLES, BUCKET, BLOCK, SEED = 4, 64, 2048, 11


@functools.lru_cache(8)
def _signs(size: int, functions: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).choice([-1.0, 1.0], (TABLES, functions, 3, size))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows times the Hadamard matrix of their length, a power of two, in n log n steps."""
    h = 1
    while h < x.shape[1]:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), -1)
        h *= 2
    return x


def bucket_keys(x: np.ndarray, functions: int, salt: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Keys of the buckets of each row: tables times two to the functions. salt: keeps labels apart."""
    size = 1 << max(1, x.shape[1] - 1).bit_length()
    padded = np.zeros((len(x), size))
    padded[:, : x.shape[1]] = x
    out = []
    for t in range(TABLES):
        keys = mix(mix(salt.astype(np.int64).view(np.uint64), 17) + np.uint64(x.shape[1]), t + 1)[:, None]
        for f in range(functions):
            y = padded
            for s in _signs(size, functions, seed)[t, f]:
                y = hadamard(y * s)
            two = np.argpartition(-np.abs(y), 1, 1)[:, :2] if size > 2 else np.tile(np.arange(size)[:2], (len(x), 1))
            vertex = (2 * two + (np.take_along_axis(y, two, 1) > 0)).astype(np.uint64)
            keys = mix(keys[:, :, None] * np.uint64(0x9E3779B97F4A7C15) + vertex[:, None, :], f + 1).reshape(len(x), -1)
        out.append(keys)
    return np.concatenate(out, 1).view(np.int64)


def _matrix(column) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _keyed(functions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array(batch.column(2).to_pylist())
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                x = _unit(_matrix(part.column(3)))
                keys = bucket_keys(x, functions, part.column(1).to_numpy())
                of = np.repeat(np.arange(len(x)), keys.shape[1])
                taken = part.take(pa.array(of))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel()), *(taken.column(i) for i in (0, 1, 3, 4))],
                    ["bucket", "k", "label", "vector", "copies"],
                )

    return run


def _links(least: float, functions: int):
    def in_group(rows: list[tuple]) -> tuple[list, list, np.ndarray, np.ndarray]:
        bucket = rows[0][0]
        k = np.array([r[3] for r in rows], np.int64)
        label = np.array([r[4] for r in rows], np.int64)
        copies = np.array([r[6] for r in rows], np.int64)
        x = _unit(np.array([r[5] for r in rows], np.float64))
        mine = np.array([r[7] for r in rows])
        split = rows[0][1] != rows[0][2]
        keys = np.sort(bucket_keys(x, functions, label), 1)
        count = np.zeros(len(rows), np.int64)
        a_all, b_all = [], []
        for i in range(0, len(x), 512):
            near = x[i : i + 512] @ x.T >= least
            a, b = np.nonzero(near)
            a += i
            ok = (a < b) & (label[a] == label[b])
            if split:
                ok &= mine[a] != mine[b]
            a, b = a[ok], b[ok]
            for j in range(0, len(a), 1 << 15):
                p, q = a[j : j + (1 << 15)], b[j : j + (1 << 15)]
                same = (keys[p][:, :, None] == keys[q][:, None, :]).any(2)
                first = keys[p, same.argmax(1)] == bucket
                p, q = p[first], q[first]
                count += np.bincount(p, copies[q], len(rows)).astype(np.int64) + np.bincount(q, copies[p], len(rows)).astype(np.int64)
                if len(p):
                    f, g = forest(k[p], k[q])
                    a_all.append(f)
                    b_all.append(g)
        got = np.flatnonzero(count)
        ea, eb = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a_all, b_all))
        if len(ea):
            ea, eb = forest(ea, eb)
        return k[got].tolist(), count[got].tolist(), ea, eb

    def closed(rows: list[tuple]) -> list:
        by_size: dict[int, list[tuple]] = {}
        for row in rows:
            by_size.setdefault(len(row[5]), []).append(row)
        return [in_group(x) for x in by_size.values() if len(x) > 1]

    def made(out: list) -> pa.RecordBatch:
        kind = [0] * sum(len(o[0]) for o in out) + [1] * sum(len(o[2]) for o in out)
        a = [v for o in out for v in o[0]] + [int(v) for o in out for v in o[2]]
        b = [v for o in out for v in o[1]] + [int(v) for o in out for v in o[3]]
        return pa.RecordBatch.from_arrays([pa.array(kind, pa.int8()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["kind", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[:3] != held[0][:3]:
                    out += closed(held)
                    held = []
                    if len(out) > 2000:
                        yield made(out)
                        out = []
                held.append(row)
        yield made(out + closed(held))

    return run


def near_duplicates(
    vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """id, n_links, component_id and kept for every row."""
    spark = vectors.sparkSession
    vector = F.col(vector_col).cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(vector, lambda x: x != 0)
    usable = F.coalesce(F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & finite, F.lit(False))
    label = F.xxhash64(F.col(label_col).cast("string"))  # stands for labels of any type
    rows = vectors.select(F.col(id_col).alias("id"), label.alias("label"), vector.alias("vector"), usable.alias("usable"))
    rows = rows.withColumn("k", F.when(F.col("usable"), F.xxhash64("label", F.size("vector"), "vector")))
    classes = rows.filter("usable").groupBy("k").agg(
        F.first("label").alias("label"), F.first(F.size("vector")).alias("size"), F.first("vector").alias("vector"),
        F.count(F.lit(1)).alias("copies"),
    )
    classes = table(classes, "vectors")
    most = classes.groupBy("label", "size").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("d")).agg(F.max("n"), F.max("d")).first()
    functions = max(1, math.ceil(math.log(max(1, (most[0] or 1) / BUCKET)) / math.log(2 * (1 << max(1, (most[1] or 2) - 1).bit_length()))))
    dealt = arrow(
        classes.select("k", "label", "size", "vector", "copies"), _keyed(functions),
        "bucket long, k long, label long, vector array<double>, copies long",
    )
    dealt = table(dealt, "buckets")
    large = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK)
    dealt = dealt.join(large, "bucket", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("n") / BLOCK), F.lit(1)).cast("long"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64(F.col("k"), F.lit(3)), F.col("blocks"))).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)),
    )
    dealt = dealt.select(
        "bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "k", "label", "vector",
        "copies", "own",
    )
    dealt = dealt.repartition(width(spark), "bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
    found = table(arrow(dealt, _links(least, functions), "kind tinyint, a long, b long"), "links")
    degree = found.filter("kind = 0").groupBy(F.col("a").alias("k")).agg(F.sum("b").alias("others"))
    whole = components(found.filter("kind = 1").select("a", "b"))
    known = classes.select("k", "copies").join(degree, "k", "left").join(whole.withColumnRenamed("node", "k"), "k", "left")
    known = known.select(
        "k", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "k").alias("component"),
    )
    grouped = rows.select("id", "k").join(known, "k", "left")
    lowest = grouped.filter("k IS NOT NULL").groupBy("component").agg(F.min("id").alias("component_id"))
    out = grouped.join(lowest, "component", "left")
    component = F.when(F.col("k").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"),
    )
