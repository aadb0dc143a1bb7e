"""Model inputs, priors, titles, addresses."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lexigrove.operators import features as X
from lexigrove.operators.render import ENTITY_CODES

VOCAB = {t: i for i, t in enumerate(["[PAD]", "[CLS]", "[SEP]", "a", "b"])}


def test_inputs(spark):
    asked = spark.createDataFrame([(1, ["a", "b", "a"])], "qid int, pieces array<string>")
    r = X.question_inputs(asked, VOCAB, 2).first()
    assert (r.input_ids, r.input_mask) == ([1, 3, 4, 2], [1, 1, 1, 1])
    r = X.question_inputs(asked, VOCAB, 4).first()
    assert (r.input_ids, r.input_mask) == ([1, 3, 4, 3, 2, 0], [1, 1, 1, 1, 1, 0])
    text = spark.createDataFrame([(7, list("abab"))], "doc_id int, pieces array<string>")
    got = [tuple(x) for x in X.context_inputs(text, VOCAB, 5, 2).orderBy("window_idx").collect()]
    assert got == [(7, 0, 0, [1, 3, 4, 3, 2]), (7, 1, 2, [1, 3, 4, 2])]
    with pytest.raises(Exception, match="not in the vocabulary"):
        X.question_inputs(asked, {"[CLS]": 1, "[SEP]": 2, "a": 3}).collect()


def test_corpus_helpers(spark):
    articles = spark.createDataFrame([(0, "u", "t"), (1, "u", "t"), (2, "v", "t")], "doc_id long, cord_uid string, title string")
    priors = spark.createDataFrame([("q", "u", 1.0), ("q", "w", 2.0)], "question string, cord_uid string, prior double")
    assert [tuple(r) for r in X.priors_by_document(priors, articles).collect()] == [("q", 1, 1.0)]
    assert [r.unique_title for r in X.unique_titles(articles).orderBy("doc_id").collect()] == ["t", "t_0", "t_1"]
    vectors = spark.range(1000).select((F.col("id") % 50).alias("doc_id"), "id")
    drawn = X.sample_vectors(vectors, 0.5, 0.5)
    assert 0 < drawn.select("doc_id").distinct().count() < 50
    assert X.draft(vectors, 3).count() == X.draft(vectors, 3, 1).count() == 3
    assert X.cached_page(spark.range(5).withColumnRenamed("id", "rank")).count() == 3


def test_addresses(spark):
    frame = spark.createDataFrame([("lung cancer?", "Gene", None), ("x", "other", "tag")], "q string, k string, e string")
    made = frame.select(X.entity_request(F.col("q"), F.col("k"), 10, "http://h/?", ENTITY_CODES, "t=l&otype="), X.cache_name(F.col("q"), F.col("e"))).collect()
    assert made[0][0] == "http://h/?t=l&otype=8&rows=10&q=lung%20cancer%3F" and "otype=&rows" in made[1][0]
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert made[0][1] == digest("lung cancer?") and made[1][1] == f"{digest('x')}.{digest('tag')}"
