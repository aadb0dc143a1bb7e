"""Toxicity: features against brute force, held-out accuracy, interactions, odd inputs."""

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lexigrove.llm import toxicity
from lexigrove.llm.textwords import WHITE, hashes, pieces, spans, sums


def test_spans_and_hashes_equal_brute_force():
    texts = ["A b  c", None, "", " \n", "x" * 3000 + " y", "b\tc", "é é"]
    for _, data, at in pieces(pa.array(texts), 50):
        raw = bytes(data)
        start, end, of = spans(data, at, WHITE)
        want = [(raw[a:b][m.start() : m.end()], i) for i, (a, b) in enumerate(zip(at[:-1], at[1:])) for m in re.finditer(rb"[^ \t-\r]+", raw[a:b])]
        assert [(raw[a:b], i) for a, b, i in zip(start, end, of)] == want
        codes = {}
        for h, (w, _) in zip(hashes(sums(data), start, end), want):
            assert codes.setdefault(w.lower(), h) == h
        assert len(set(codes.values())) == len(codes)


def test_margin_equals_the_sum_over_pairs():
    random = np.random.default_rng(1)
    m = toxicity.Machine(0.3, random.normal(size=1 << toxicity.BITS), random.normal(size=(1 << toxicity.BITS, 3)))
    feature = np.array([5, 9, 70])
    want = 0.3 + m.linear[feature].sum() + sum(m.factors[a] @ m.factors[b] for i, a in enumerate(feature) for b in feature[i + 1 :])
    assert np.allclose(m.margin(np.zeros(3, int), feature, 1), want)


def test_interactions_are_learned():
    """Either term alone is harmless; only both together are not."""
    random = np.random.default_rng(2)
    rows, labels = [], []
    for _ in range(3000):
        a, b = (bool(x) for x in random.random(2) < 0.5)
        rows.append(np.array([1] * a + [2] * b + [10 + int(random.integers(5))], np.int64))
        labels.append(int(a and b))
    m = toxicity.train(rows, np.array(labels), 0.25)
    score = [m.score(np.zeros(len(x), int), np.array(x), 1)[0] for x in ([1], [2], [1, 2])]
    assert score[2] > 0.7 > 0.5 > max(score[:2])


def test_pairs_of_terms_that_tell_nothing_alone():
    """A group's name and a slur are as common in either class; toxic are the texts with both or neither."""
    random = np.random.default_rng(4)
    rows, labels = [], []
    for _ in range(4000):
        a, b = (bool(x) for x in random.random(2) < 0.5)
        rows.append(np.array([1] * a + [2] * b + [10 + int(random.integers(50))], np.int64))
        labels.append(int(a == b))
    m = toxicity.train(rows, np.array(labels), 0.5)
    score = [m.score(np.zeros(len(x), int), np.array(x), 1)[0] for x in ([1], [2], [1, 2])]
    assert score[2] > 0.6 > 0.4 > max(score[:2])


def test_a_rare_pair_is_learned():
    """Two terms of a tenth of all texts each among many others; toxic are the texts with both, a hundredth."""

    def drawn(n, seed):
        random = np.random.default_rng(seed)
        rows, labels = [], []
        for _ in range(n):
            a, b = (bool(x) for x in random.random(2) < 0.1)
            rows.append(np.unique(np.r_[random.integers(100, 2000, 20), [5] * a, [7] * b].astype(np.int64)))
            labels.append(int(a and b))
        return rows, np.array(labels)

    m = toxicity.train(*drawn(6000, 0), 0.5)
    rows, labels = drawn(3000, 9)
    score = m.score(np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows), len(rows))
    assert (score[labels == 1] >= 0.7).mean() > 0.7 and (score[labels == 0] >= 0.7).mean() < 0.01


def test_rare_toxic_terms_are_learned():
    """A term of six toxic texts, too few to stand out by its own count."""
    random = np.random.default_rng(5)
    rows = [random.choice(np.arange(10, 60), 5, replace=False) for _ in range(2000)]
    labels = np.repeat([0, 1], 1000)
    rows = [np.r_[r, 1] if i >= 1994 else np.r_[r, 2] if y and i % 2 else r for i, (r, y) in enumerate(zip(rows, labels))]
    m = toxicity.train(rows, labels, 0.5)
    plain, rare = m.margin(np.zeros(1, int), np.array([10]), 1)[0], m.margin(np.zeros(2, int), np.array([10, 1]), 1)[0]
    assert rare > plain + 0.1


def test_held_out_accuracy_and_clashing_columns(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumn("_text", F.lit("x")).withColumn("score", F.lit(1))
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.toxicity(docs, labels.unionAll(labels)).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    out = [r for r in got if r.held_out]
    assert sum(r.predicted for r in out if r.toxic) >= 0.5 * sum(r.toxic for r in out)
    assert sum(r.predicted for r in out if not r.toxic) <= 0.05 * len(out)


def test_nulls_and_empty_tables(spark):
    schema = "doc_id long, text string"
    docs = spark.createDataFrame([(None, "a"), (1, None), (2, ""), (2, "b")], schema)
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 4 and all(r.score < 0.01 and r.predicted == 0 for r in got)
    assert toxicity.toxicity(spark.createDataFrame([], schema), labels).count() == 0


def test_the_driver_trains_on_narrow_features_as_on_wide_ones(spark, monkeypatch):
    seen = []
    train = toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda rows, *a: seen.append(rows) or train(rows, *a))
    docs = spark.createDataFrame([(i, "bad word" if i % 2 else "good word") for i in range(20)], "doc_id long, text string")
    machine = toxicity.fit(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) AS toxic"))
    assert {r.dtype for r in seen[0]} == {np.dtype(np.int32)}
    wide = train([r.astype(np.int64) for r in seen[0]], np.array([0] * 10 + [1] * 10), 0.5)
    assert machine.bias == wide.bias and (machine.linear == wide.linear).all() and (machine.factors == wide.factors).all()
