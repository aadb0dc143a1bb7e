"""Stores, encoders and the plan of the search on small frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrove.functions import arrays, text
from lexigrove.operators import encode, evaluate, features, index_store, phrase, vindex
from lexigrove.plans import answer
from lexigrove.sources import readers, scratch, writers


def test_scanned_is_a_running_fold(spark):
    for n in (0, 1, 63, 64, 65, 1000):
        items = F.sequence(F.lit(1), F.lit(n)) if n else arrays.empty("array<int>")
        made = arrays.scanned(items, F.lit(0), "array<int>", lambda at, x: (at + x, at + x))
        assert spark.range(1).select(made).first()[0] == list(np.cumsum(np.arange(1, n + 1)))


def test_token_f1_of_repeated_words(spark):
    rows = [("a b b c c c", "b b b c d", 2 * 3 / 11), ("", "x", 0.0), ("yes", "yes yes", 0.0), ("x " * 300, "x " * 200, 2 * 200 / 500), (None, "x", None)]
    frame = spark.createDataFrame(rows, "p string, t string, f double")
    for r in frame.select("f", evaluate.token_f1(F.regexp_replace("p", r"\ba\b", "e"), F.col("t"))["f1"].alias("got")).collect():
        assert r.f is None or np.isclose(r.got, r.f)


def test_postings_keep_their_parameters(spark):
    path = scratch.folder(spark, "postings")
    frame = spark.createDataFrame([(1, "a", 2)], "doc_id long, term string, tf long")
    writers.write_postings(frame, path, 2)
    assert readers.postings(spark, path).count() == 1
    with pytest.raises(ValueError, match="ngram=2"):
        readers.postings(spark, path, 3)


def test_paragraphs_are_replaced_one_by_one(spark):
    path = scratch.folder(spark, "paragraphs")
    schema = "doc_id long, par_idx long, term string, weight double"
    writers.write_paragraphs(spark.createDataFrame([(1, 0, "a", 1.0), (1, 1, "b", 1.0), (2500, 0, "c", 1.0)], schema), path)
    writers.write_paragraphs(spark.createDataFrame([(1, 1, "d", 2.0), (1, 2, "e", 2.0)], schema), path)
    got = sorted(tuple(r)[:4] for r in readers.paragraph_postings(spark, path).select("doc_id", "par_idx", "term", "weight").collect())
    assert got == [(1, 0, "a", 1.0), (1, 1, "d", 2.0), (1, 2, "e", 2.0), (2500, 0, "c", 1.0)]
    assert readers.paragraph_postings(spark, path, (2000, 3000)).count() == 1


def test_index_of_trained_centroids(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    path = scratch.folder(spark, "index")
    index_store.build(vectors, path, clusters=8)
    index = index_store.load(spark, path)
    queries = vectors.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query"))
    exact = sorted((r.qid, r.vec_id, r.score) for r in vindex.exact_top_k(index.vectors(), queries, 10).collect())
    found = sorted((r.qid, r.vec_id, r.score) for r in index.search(queries, 10, 8).collect())
    assert index.lists.count() == vectors.count() and np.allclose(exact, found, atol=2e-6)


def test_query_blocks_change_nothing(spark, sf, monkeypatch):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    queries = vectors.filter("vec_id < 40").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query"))
    whole = sorted(map(tuple, vindex.exact_top_k(vectors, queries, 3).collect()))
    monkeypatch.setattr(vindex, "QUERY_BLOCK", 15)
    assert sorted(map(tuple, vindex.exact_top_k(vectors, queries, 3).collect())) == whole
    assert vindex.exact_top_k(vectors, queries.limit(0), 3).count() == 0


def test_encoders(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, None)], "id long, text string")
    got = {r.id: r.vector for r in encode.encoded(rows, lambda texts: np.array([[len(t), 1.0, 2.0] for t in texts])).collect()}
    assert got == {1: [2.0, 1.0, 2.0], 2: [0.0, 1.0, 2.0]}
    weights = encode.sparse_weights(np.eye(3), np.ones((3, 3)), np.array([5, 1000, 2000]))
    assert np.allclose(weights, np.array([[0, 1, 1], [0, 0, 1], [0, 1, 0]]) / np.sqrt(3))


def test_numbered_copies_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(features, "KEYS_EACH", 4)
    rows = [(i, "x" if i % 3 else f"y{i}") for i in range(40)]
    got = {r.doc_id: (r.copy, r.first_doc, r.last_doc) for r in features.numbered_copies(spark.createDataFrame(rows, "doc_id long, v string"), "v").collect()}
    some = [i for i, v in rows if v == "x"]
    assert got == {i: (some.index(i), some[0], some[-1]) if v == "x" else (0, i, i) for i, v in rows}


def test_entry_points_and_strategies(spark):
    assert answer.parameters("batch").nprobe == 64 and answer.parameters("page", top_k=3).aggregate and answer.parameters().meta_scale == 100
    with pytest.raises(ValueError, match="unknown strategy"):
        answer.found_by(None, None, answer.parameters(strategy="other"))


def test_masked_starts_have_no_end(spark):
    starts = spark.createDataFrame([(0, 1, 0, 1.0, [1.0], [-1, -1], [0.0]), (0, 1, 1, 1.0, [1.0], [1, 2], [])], "qid int, doc_id long, start_idx long, score double, end_query array<double>, start2end array<long>, span array<double>")
    ends = spark.createDataFrame([(1, 1, [2.0]), (1, 2, [2.0])], "doc_id long, end_idx long, end_vec array<double>")
    got = {r.start_idx: (r.end_idx, r.end_score) for r in phrase.ends_through(starts, ends).collect()}
    assert got == {0: (None, None), 1: (1, 3.0)}


def test_broken_utf8_leaves_no_trace(spark):
    frame = spark.createDataFrame([(b"a\xffb",), (None,), ("é".encode(),)], "x binary")
    assert [r[0] for r in frame.select(text.utf8_text(F.col("x"))).collect()] == ["ab", None, "é"]


def test_murmur_of_many_lengths():
    def one(data, seed=0):
        h, n = seed, len(data) // 4 * 4
        for i in range(0, n, 4):
            k = int.from_bytes(data[i : i + 4], "little") * 0xCC9E2D51 & 0xFFFFFFFF
            h ^= (k << 15 | k >> 17) * 0x1B873593 & 0xFFFFFFFF
            h = ((h << 13 | h >> 19) & 0xFFFFFFFF) * 5 + 0xE6546B64 & 0xFFFFFFFF
        if data[n:]:
            k = int.from_bytes(data[n:], "little") * 0xCC9E2D51 & 0xFFFFFFFF
            h ^= (k << 15 | k >> 17) * 0x1B873593 & 0xFFFFFFFF
        h ^= len(data)
        for m, s in ((0x85EBCA6B, 16), (0xC2B2AE35, 13)):
            h = (h ^ h >> s) * m & 0xFFFFFFFF
        return h ^ h >> 16

    r = np.random.default_rng(1)
    words = [r.integers(0, 256, n, dtype=np.uint8).tobytes() for n in list(range(20)) * 3]
    assert text._hashed(words).tolist() == [one(w) for w in words]
