"""The whole search on a hand-made corpus."""

import pytest

from lexigrove.plans.answer import Parameters, answers


def frames(spark):
    texts = {1: "red fox runs\nblue dog sits\nend", 2: "red cat naps"}
    docs = spark.createDataFrame([(i, t, "s") for i, t in texts.items()], "doc_id long, text string, article string")
    tokens, at = [], {}
    for i, t in texts.items():
        place = 0
        for k, w in enumerate(t.split()):
            place = t.index(w, place)
            tokens.append((i, k, place, place + len(w)))
            at[i, k] = w
            place += len(w)
    tokens = spark.createDataFrame(tokens, "doc_id long, idx long, char_start int, char_end int")
    phrases = spark.createDataFrame([(1, 1, 3, 0.9, [1.0], [0.0, 0.0]), (1, 1, 0, 0.2, [1.0], [0.0]), (1, 2, 1, 0.5, [1.0], [0.0])], "qid int, doc_id long, start_idx long, dense double, end_query array<double>, span array<double>")
    scores = spark.createDataFrame([(1, 2, 10.0)], "qid int, doc_id long, doc_score double")
    ends = spark.createDataFrame([(1, 3, [0.1]), (1, 4, [0.7]), (2, 1, [0.2])], "doc_id long, end_idx long, end_vec array<double>")
    return phrases, scores, tokens, docs, ends


def test_dense_first_answers(spark):
    got = answers(*frames(spark)).orderBy("rank").collect()
    assert [(r.doc_id, r.answer, r.score) for r in got] == [(2, "cat", 1.0), (1, "blue dog", 0.9), (1, "red fox runs\nblue dog", 0.2)]
    blue = got[1]
    assert (blue.sent_start, blue.sent_end, blue.c_start, blue.c_end) == (13, 27, 0, 30)


def test_other_strategies(spark):
    phrases, scores, tokens, docs, ends = frames(spark)
    sparse = answers(phrases, scores, tokens, docs, ends, p=Parameters(strategy="sparse_first")).collect()
    assert [r.answer for r in sparse] == ["cat"]
    extra = spark.createDataFrame([(1, 1, 0, 5.0)], "qid int, doc_id long, start_idx long, extra double")
    top = answers(phrases, scores, tokens, docs, ends, extra, Parameters(strategy="hybrid", aggregate=True)).collect()
    assert [(r.answer, r.rank) for r in top] == [("red fox runs\nblue dog", 1)]
    with pytest.raises(ValueError):
        answers(phrases, scores, tokens, docs, ends, p=Parameters(strategy="other"))
