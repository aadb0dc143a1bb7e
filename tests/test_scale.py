"""Queries and operators on odd and larger inputs."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrove import catalogue
from lexigrove.functions import text as X
from lexigrove.operators import counting, tfidf, vindex, windows


@pytest.fixture
def folder(spark, tmp_path):
    """A function that writes tables and gives their folder."""

    def write(**tables):
        for name, frame in tables.items():
            frame.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def documents(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def test_empty_text_has_no_segment(spark, folder):
    d = folder(documents=documents(spark, ["", None, "\n", "ab\ncd", "abc\nd\n"]))
    rows = catalogue.QUERIES["par_segment_adjust"](spark, d).orderBy("doc_id").collect()
    assert [(r.doc_id, r.segment_chars, r.start_pos) for r in rows] == []
    d = documents(spark, ["", "abcd\ne"])
    d.write.mode("overwrite").parquet(f"{folder()}/documents.parquet")
    rows = catalogue.QUERIES["par_segment_adjust"](spark, folder()).collect()
    assert [(r.doc_id, r.segment_chars, r.start_pos) for r in rows] == [(1, 4, 3)]


ODD = [
    "", None, "\n", "a", "The quick\n\nbrown Fox fox fox. Fox", "İstanbul ΣΑΣ Σ x́y é \U0001f600\U0001f600 ok", "日本語 テキスト テキスト",
    "  a b ", ". , !", "zebra zebra zebra\nzebra dog", "red fox\nblue dog", "red fox red fox",
]


def exploded(docs, key="doc_id"):
    each = docs.select(key, F.explode(X.terms(F.col("text"))).alias("term"))
    return each.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def listed(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=str)


def exchanges(frame):
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"(?m)^\W*Exchange hash", plan))


@pytest.mark.parametrize("again", [0, 4])
def test_terms_are_counted_where_the_texts_are(spark, again):
    """again: texts whose key another text has too."""
    docs = documents(spark, ODD).unionByName(documents(spark, ["red fox zebra", "", "a Fox", "blue"][:again], 8))
    docs = docs.unionByName(docs.filter("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long")))
    names = "doc_id", "term", "tf"
    counts = tfidf.term_counts(docs)
    assert listed(counts, *names) == listed(exploded(docs), *names)
    assert again or not exchanges(counts)
    only = spark.createDataFrame([("fox",), ("red fox",), ("zebra zebra",), ("nowhere",)], "term string")
    assert listed(tfidf.term_counts(docs, only=only), *names) == listed(exploded(docs).join(only, "term"), *names)
    made = exploded(docs).withColumn("bucket", X.term_bucket(F.col("term"), 50)).groupBy("doc_id", "bucket").agg(F.sum("tf").alias("tf"))
    assert listed(tfidf.bucket_counts(docs, size=50), "doc_id", "bucket", "tf") == listed(made, "doc_id", "bucket", "tf")
    assert again or not exchanges(tfidf.bucket_counts(docs))


@pytest.mark.parametrize("again", [0, 4])
@pytest.mark.parametrize("common", [2000, 4])
def test_weights_by_one_shuffle_of_rare_terms(spark, monkeypatch, again, common):
    monkeypatch.setattr(tfidf, "COMMON", common)
    docs = documents(spark, ODD * 3).unionByName(documents(spark, ["red fox zebra", "", "a Fox", "blue"][:again], 8))
    df, size = tfidf.document_frequencies(exploded(docs)), tfidf.corpus_size(docs)
    names = "doc_id", "term", "tf", F.round("weight", 9)
    assert listed(tfidf.term_weights(docs), *names) == listed(tfidf.weights(exploded(docs), df, size), *names)
    pars = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("par_idx", "text"))
    counts = exploded(pars.select(F.struct("doc_id", "par_idx").alias("key"), "text"), "key").select("key.*", "term", "tf")
    names = "doc_id", "par_idx", "term", "tf", F.round("weight", 9)
    assert listed(tfidf.paragraph_weights(docs), *names) == listed(tfidf.weights(counts, df, size), *names)


def test_bytes_that_are_no_text(spark):
    docs = spark.createDataFrame([(1, bytearray(b"red \xff fox")), (2, bytearray(b"blue"))], "doc_id long, text binary").withColumn("text", F.col("text").cast("string"))
    assert [r.term for r in tfidf.term_counts(docs, n=1).orderBy("doc_id", "term").collect()] == ["fox", "red", "�", "blue"]


def nearest(queries, vectors, k, pairs):
    """Best k (query, vector, score) of the pairs."""
    out = []
    for i, q in enumerate(queries):
        own = sorted((-round(float(np.dot(q, v)), 6), j) for j, v in enumerate(vectors) if pairs(i, j))
        out += [(i, j, -s) for s, j in own[:k]]
    return sorted(out)


def test_scores_are_held_in_parts(monkeypatch):
    monkeypatch.setattr(vindex, "HELD", 50)
    rng = np.random.default_rng(5)
    q, x = rng.normal(size=(9, 8)), np.round(rng.normal(size=(200, 8)))
    held = vindex._Held(9, 4, 6)
    for part in np.array_split(np.arange(200), 3):
        held.add(np.arange(9), q, part, x[part])
    row, vec, score = held.rows
    assert sorted(zip(row.tolist(), vec.tolist(), score.tolist())) == nearest(q, x, 4, lambda i, j: True)


@pytest.mark.parametrize("block", [4096, 3])
def test_probed_lists_are_scored_where_they_are(spark, monkeypatch, block):
    monkeypatch.setattr(vindex, "QUERY_BLOCK", block)
    rng = np.random.default_rng(7)
    q, x = rng.normal(size=(10, 8)), np.round(rng.normal(size=(90, 8)))
    indexed = spark.createDataFrame([(j, j % 5, v.tolist()) for j, v in enumerate(x)], "vec_id long, cluster_id int, embedding array<double>")
    probes = spark.createDataFrame([(i, v.tolist(), c) for i, v in enumerate(q) for c in (i % 5, (i + 2) % 5)], "qid long, query array<double>, cluster_id int")
    found = vindex.probed_top_k(indexed, probes, 6)
    assert sorted((r.qid, r.vec_id, r.score) for r in found.collect()) == nearest(q, x, 6, lambda i, j: j % 5 in (i % 5, (i + 2) % 5))
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_spans_by_running_sums(spark):
    docs = documents(spark, ODD)
    frame = docs.select("doc_id", "text", X.token_spans(F.col("text")).alias("t"))
    for r in frame.collect():
        text = r.text or ""
        assert [text[x.start : x.end] for x in r.t] == [x.text for x in r.t]
        assert "".join(x.text + x.after for x in r.t) == (text[r.t[0].start :] if r.t else "")
    assert "aggregate(" not in frame._jdf.queryExecution().optimizedPlan().toString()  # no list is copied for each token


def test_gram_sizes_equal_the_grams(spark):
    docs = documents(spark, ODD)
    found = counting.gram_sizes(docs, {"any": "any", "all": "all", "ends": "ends", "whole": None, "kept": lambda w: len(w) == 3})
    words = X.tokens(F.col("text"))
    made = docs.filter(F.size(words) > 0)
    columns = ["doc_id"]
    for name, grams in ({m: X.ngrams(words, 3, m) for m in ("any", "all", "ends")} | {"whole": X.ngrams(words, 3, None), "kept": X.ngrams(words, 3, keep=lambda g: F.size(g) == 3)}).items():
        made = made.withColumn(f"n_{name}", F.size(grams)).withColumn(f"chars_{name}", F.aggregate(grams, F.lit(0), lambda s, g: s + F.length(g)))
        columns += [f"n_{name}", f"chars_{name}"]
    assert listed(found, *columns) == listed(made, *columns)


def test_best_windows_by_their_definition(spark):
    for n, length, stride in ((0, 8, 3), (1, 8, 3), (40, 8, 3), (64, 64, 32), (200, 64, 32), (30, 5, 20)):
        step = min(length, stride)
        bounds = [(i * step, min(i * step + length, n)) for i in range(1 if n <= length else 1 - (length - n) // step)]
        want = [-max((min(p - a, b - 1 - p) + 0.01 * (b - a), -i) for i, (a, b) in enumerate(bounds) if a <= p < b)[1] for p in range(n)]
        assert spark.range(1).select(windows.best_window(F.lit(n), length, stride)).first()[0] == want


def test_batches_are_bounded(spark, sf):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    catalogue.QUERIES["nfd_terms"](spark, sf)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 4 << 20



def test_scores_are_summed_where_the_texts_are(spark, monkeypatch):
    """With no room for questions in tasks the same scores come from joins."""
    docs = documents(spark, ODD * 2 + ["fox news", "dog zebra fox"])
    asked = spark.createDataFrame([(7, "red fox zebra"), (3, "the quick dog, the Fox"), (5, "")], "item_id long, text string")
    here = tfidf.doc_scores_all(asked, docs), tfidf.top_docs(asked, docs, 3)
    assert "Join" not in here[0]._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(tfidf, "QUESTIONS", 0)
    joined = tfidf.doc_scores_all(asked, docs), tfidf.top_docs(asked, docs, 3)
    for a, b in zip(here, joined):
        assert listed(a, *a.columns) == listed(b, *a.columns) and a.count()


def test_words_keep_their_places_without_a_shuffle(spark):
    docs = documents(spark, [*ODD, "a\tb c  d\r\n e", "日本 語"])
    frame = windows.word_offsets(docs)
    assert not exchanges(frame)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    want = [(i, m.group(), m.start()) for i, t in texts.items() for m in re.finditer("[^ \t\r\n ]+", t)]
    assert listed(frame, "doc_id", "word", "start") == sorted(want, key=str)
    assert [r.idx for r in counting.words_between(docs.filter("doc_id = 4")).orderBy("start").collect()] == list(range(7))
