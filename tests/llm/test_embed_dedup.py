"""Vector dedup against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrove.llm import embed_dedup as E


def brute(rows):
    ok = [v is not None and l is not None and None not in v and all(map(math.isfinite, v)) and any(v) for _, v, l in rows]
    root = list(range(len(rows)))
    links = [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], np.float64), np.array(rows[j][1], np.float64)
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.98:
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
    out = []
    for i, (key, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((key, links[i], least, key == least))
    return sorted(out, key=str)


@pytest.mark.parametrize("bucket,block", [(64, 2048), (1, 7)])
def test_equals_brute_force(spark, monkeypatch, bucket, block):
    monkeypatch.setattr(E, "BUCKET", bucket)
    monkeypatch.setattr(E, "BLOCK", block)
    r = np.random.default_rng(bucket)
    centre = r.normal(size=(6, 20))
    rows = []
    for i in range(220):
        v = centre[r.integers(6)] + r.normal(size=20) * r.choice([0, 0.05, 0.1, 0.15, 3])
        rows.append((i, [float(np.float32(x)) for x in v * r.choice([1, 1, 2])], int(r.integers(3))))
    rows += [
        (300, None, 1), (301, [0.0] * 20, 1), (302, [None] * 20, 1), (303, [float("nan")] * 20, 1),
        (304, [float("inf")] + [1.0] * 19, 1), (305, rows[0][1], None),
    ]
    rows += [
        (306, [1.0, 2.0], 1), (307, [1.0, 2.0], 1), (None, [1.0, 2.0], 1), (308, [], 1), (309, [3.0], 2), (310, [-3.0], 2),
        (310, rows[5][1], rows[5][2]), (310, rows[5][1], rows[5][2]),
    ]
    frame = spark.createDataFrame([(*x, 0) for x in rows], "vec_id long, embedding array<float>, label int, k int").repartition(3)
    assert sorted(map(tuple, E.near_duplicates(frame).collect()), key=str) == brute(rows)


def test_a_table(spark, sf):
    frame = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding), r.label) for r in frame.collect()]
    got = sorted(map(tuple, E.near_duplicates(frame).collect()), key=str)
    want = brute(rows)
    assert sum(a == b for a, b in zip(got, want)) >= 0.99 * len(want)
    assert E.near_duplicates(frame.filter(F.lit(False))).count() == 0


def test_hadamard_is_orthogonal():
    h = E.hadamard(np.eye(16))
    assert np.array_equal(h @ h.T, 16 * np.eye(16)) and set(h.ravel()) == {1.0, -1.0}


@pytest.mark.parametrize("functions", [1, 2, 3])
def test_recall_at_the_threshold(functions):
    """Pairs of 64 dimensions at cosine 0.98 share a bucket, for as many functions as large tables take."""
    r = np.random.default_rng(functions)
    x, y = r.normal(size=(2, 1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    y = 0.98 * x + math.sqrt(1 - 0.98**2) * y
    a, b = (E.bucket_keys(v, functions, np.zeros(len(v), np.int64)) for v in (x, y))
    assert (a[:, :, None] == b[:, None, :]).any((1, 2)).mean() >= 0.999


def test_labels_are_of_any_type(spark):
    rows = [(1, [1.0, 2.0], "a"), (2, [1.0, 2.0], "a"), (3, [1.0, 2.0], "b"), (4, [1.0, 2.0], None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    assert sorted(map(tuple, E.near_duplicates(frame).collect())) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 0, 4, True)]
