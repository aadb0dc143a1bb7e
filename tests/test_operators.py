"""Operators on small hand-made frames, and every query against its SQL."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrove import catalogue
from lexigrove.functions import text as X
from lexigrove.operators import evaluate, render, search, tfidf, vindex, windows
from lexigrove.sources import readers, writers
from lexigrove.streaming import ingest


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def plain(v):
    return float(v) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, sf, name):
    frame = catalogue.QUERIES[name](spark, sf)
    names = sorted(frame.columns)
    got = sorted((tuple(map(plain, r)) for r in frame.select(*names).collect()), key=str)
    if name not in catalogue.ORACLES:
        assert got
        return
    con = duckdb.connect()
    for t in "documents benchmark labels embeddings conversations events pages".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = con.execute(catalogue.ORACLES[name])
    place = [[d[0] for d in found.description].index(n) for n in names]
    assert got == sorted((tuple(plain(r[i]) for i in place) for r in found.fetchall()), key=str)


def test_window_bounds_cover_every_token(spark):
    frame = spark.range(0, 60).select(F.col("id").cast("int").alias("n"))
    for length, stride in ((8, 3), (8, 8), (5, 20), (1, 1)):
        for r in frame.select("n", windows.window_bounds(F.col("n"), length, stride).alias("w")).collect():
            covered, starts, step = set(), [], min(length, stride)
            start = 0
            while r.n and True:  # windows by their definition
                starts.append(start)
                if start + length >= r.n:
                    break
                start += step
            assert [w.start for w in r.w] == starts
            for w in r.w:
                covered |= set(range(w.start, w.stop))
            assert covered == set(range(r.n))


def test_best_window_prefers_context_then_the_first(spark):
    got = spark.range(1).select(windows.best_window(F.lit(12), 8, 4)).first()[0]
    want = []
    for p in range(12):
        own = [(min(p - a, b - 1 - p) + 0.01 * (b - a), -i) for i, (a, b) in enumerate([(0, 8), (4, 12)]) if a <= p < b]
        want.append(-max(own)[1])
    assert got == want


def test_enclosing_segment(spark):
    text = "one two [PAR] three four [PAR] five"
    at = text.index("four")
    got = spark.createDataFrame([(text,)], "t string").select(windows.enclosing_segment(F.col("t"), F.lit(at), F.lit(at + 4)).alias("s")).first().s
    assert (got.segment, got.start_pos, got.end_pos) == ("three four", 6, 10)


def test_tfidf_by_hand(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red dog"), (3, "blue cat"), (4, "green bird"), (5, "grey horse"), (6, "")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "fox fox red")], "item_id long, text string")
    idf = lambda n: max(0.0, math.log((6 - n + 0.5) / (n + 0.5)))
    got = {r.doc_id: r.score for r in tfidf.top_docs(asked, docs, 5).collect()}
    one = math.log(2)
    assert got[1] == round(math.log(3) * one * idf(1) ** 2 + one * one * idf(2) ** 2, 6)
    assert got[2] == round(one * one * idf(2) ** 2, 6) and set(got) == {1, 2}
    prior = spark.createDataFrame([(1, 4, 0.5), (1, 4, 0.2), (1, 2, 0.1)], "item_id long, doc_id long, prior double")
    blended = {r.doc_id: r.score for r in tfidf.top_docs(asked, docs, 5, prior, 10.0).collect()}
    assert blended[4] == 5.0 and blended[2] == round(got[2] + 1.0, 6)


def test_token_products_multiply_out(spark):
    q = spark.createDataFrame([(1, "a", 2.0), (1, "a", 3.0), (1, "b", 1.0)], "qid long, token string, value double")
    p = spark.createDataFrame([(7, "a", 1.0), (7, "a", 10.0), (8, "c", 1.0)], "pid long, token string, value double")
    assert rows(search.token_match(q, p)) == [(1, 7, 55.0)]
    assert spark.range(1).select(search.bigram_ids(F.array(F.lit(1), F.lit(2), F.lit(3)))).first()[0] == [30524, 61047]


def test_ends_masked_and_chosen(spark):
    starts = spark.createDataFrame([(1, 1, 0, 1.0, [1.0], [0.0, 5.0]), (1, 1, 9, 1.0, [1.0], [])], "qid int, group int, start_idx long, score double, end_query array<double>, span array<double>")
    ends = spark.createDataFrame([(1, 0, [3.0]), (1, 1, [1.0])], "group int, end_idx long, end_vec array<double>")
    assert rows(search.select_ends(starts, ends, 2)) == [(1, 1, 0, 1.0, 1, 7.0), (1, 1, 9, 1.0, None, None)]


def test_candidate_stages(spark):
    phrases = spark.createDataFrame([(1, d, 0, s) for d, s in ((1, 0.9), (2, 0.8), (3, 0.1))], "qid int, doc_id int, start_idx int, dense double")
    scores = spark.createDataFrame([(1, 3, 10.0), (1, 2, 1.0)], "qid int, doc_id int, doc_score double")
    assert rows(search.dense_first(phrases, scores, 2)) == [(1, 1, 0, 0.9), (1, 2, 0, 0.85)]
    assert rows(search.sparse_first(phrases, scores, 1)) == [(1, 3, 0, 0.6)]
    assert search.hybrid(phrases, scores, 3, 1).count() == 4
    assert [r.doc_id for r in search.keep_top(search.hybrid(phrases, scores, 3, 1), 2).orderBy("rank").collect()] == [1, 2]


def test_answer_metrics(spark):
    pairs = [("the cat sat", "cat sat down"), ("yes", "yes it is"), ("", "x"), ("a b", "b")]
    frame = spark.createDataFrame(pairs, "p string, t string").select(evaluate.token_f1(F.col("p"), F.col("t")).alias("s"), evaluate.exact_match(F.col("p"), F.col("t")).alias("em"))
    got = frame.collect()
    assert [round(r.s.f1, 4) for r in got] == [0.8, 0.0, 0.0, 1.0] and [r.em for r in got] == [False, False, False, True]
    results = spark.createDataFrame([(1, 1, "no"), (1, 2, "It HAS gold here"), (2, 1, "none")], "qid long, rank int, sentence string")
    truths = spark.createDataFrame([(1, "gold"), (2, "x1"), (3, "y")], "qid long, truth string")
    asked = truths.select("qid").distinct()
    assert rows(evaluate.sentence_metrics(results, truths, asked)) == [(1, 0, 1, 0.02, 0.5), (2, 0, 0, 0.0, 0.0), (3, 0, 0, 0.0, 0.0)]
    best = evaluate.best_over_truths(spark.createDataFrame([(1, 1, "cat"), (1, 2, "gold")], "qid long, rank int, prediction string"), truths)
    assert rows(best) == [(1, 0, 1, 0.0, 1.0)]


def test_index_recall_and_upsert(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    exact = {(r.qid, r.vec_id) for r in vindex.exact_top_k(vectors, catalogue._asked_vectors(spark, sf), 10).collect()}
    found = {(r.qid, r.vec_id) for r in catalogue.QUERIES["kmeans_probe_topk"](spark, sf).collect()}
    assert len(exact & found) >= 0.9 * len(exact)
    old = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "doc_id long, v string")
    assert rows(writers.upsert(old, new)) == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(writers.missing(new, old)) == [(3, "d")]
    assert np.isclose(vindex.max_norm(vectors, 2.0).first()[0], 2.0, atol=1e-3)
    assert vindex.within_norm(vectors, 0.5).count() == 0


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_bounded_lists_find_the_exact_neighbours(spark, size):
    d = f"/root/testdata/{size}"
    found = {name: {(r.qid, r.vec_id, r.rank) for r in catalogue.QUERIES[name](spark, d).collect()} for name in ("mips_exact_topk", "ivf_bounded_topk")}
    assert found["mips_exact_topk"] == found["ivf_bounded_topk"]


def test_bounded_lists_leave_out_what_is_far(spark, monkeypatch):
    at = [(i, c, [10.0 * (c == j) + 0.01 * i for j in range(3)]) for i in range(30) for c in [i % 3]]
    vectors = spark.createDataFrame(at, "vec_id long, label int, embedding array<float>")
    asked = vectors.filter("vec_id IN (0, 7)").selectExpr("vec_id AS qid", "embedding AS query")
    probes = []
    real = vindex.listed_top_k
    monkeypatch.setattr(vindex, "listed_top_k", lambda *a: probes.append(a[4].sum()) or real(*a))
    for k, lists in ((5, 2), (15, 6)):  # ten vectors a list: five are found in the first, fifteen are not
        got = vindex.bounded_top_k(vectors.withColumnRenamed("label", "cluster_id"), asked, vindex.mean_centroids(vectors), k, 1)
        assert rows(got.select("qid", "vec_id", "rank")) == rows(vindex.exact_top_k(vectors, asked, k).select("qid", "vec_id", "rank"))
        assert probes[-1] == lists
    for some, wanted in ((vectors, asked.limit(0)), (vectors.limit(0), asked)):
        assert vindex.bounded_top_k(some.withColumnRenamed("label", "cluster_id"), wanted, vindex.mean_centroids(some), 3, 1).count() == 0


def test_markup(spark):
    text = "First one. Second has gold in it. Third."
    s, e = 11, 33
    a = text.index("gold")
    frame = spark.createDataFrame([(text,)], "t string")
    got = frame.select(render.mark_answer(F.col("t"), F.lit(s), F.lit(e), F.lit(a), F.lit(a + 4), F.lit(6), F.lit(len(text)))).first()[0]
    assert got == "... one. <em>Second has <span class='answer_span'>gold</span> in it.</em> Third."
    entities = F.array(F.struct(F.lit(0).alias("start"), F.lit(5).alias("end"), F.lit("u").alias("url")))
    assert frame.select(render.highlight(F.col("t"), entities, "c")).first()[0].startswith("<a href='u' target='_blank' class='c'>First</a> one.")
    ids = spark.createDataFrame([("MESH:D1", "drug"), ("MESH:D1", "disease"), ("NCBI:txid9", ""), ("NCBI:gene7", ""), ("z", "")], "i string, k string")
    urls = [r[0] for r in ids.select(render.entity_url(F.col("i"), F.col("k"))).collect()]
    assert urls[0].endswith("chem&acc=D1") and urls[1].endswith("disease&acc=MESH:D1") and urls[2].endswith("id=9") and urls[3].endswith("gene&acc=7") and urls[4] is None
    words = spark.createDataFrame([(["What", "vaccine", "for", "the", "WHO", "heart"],), (["none"],)], "w array<string>")
    assert [r[0] for r in words.select(render.entity_query(F.col("w"))).collect()] == ["vaccine heart", "COVID-19"]


def test_readers(spark, tmp_path):
    import json

    folder = tmp_path / "corpus"
    folder.mkdir()
    article = lambda t, *c: {"title": t, "cord_uid": t, "paragraphs": [{"context": x, "qas": [{"id": f"{t}{i}", "question": f"what is {x}", "answers": [{"text": x.split()[-1], "answer_start": 0}]}]} for i, x in enumerate(c)]}
    (folder / "0000").write_text(json.dumps({"data": [article("a", "one x", "two y"), article("b", "three z")]}))
    (folder / "0001").write_text(json.dumps({"data": [article("c", "four")]}))
    articles = readers.corpus(spark, str(folder))
    assert [(r.doc_id, r.title) for r in articles.orderBy("doc_id").collect()] == [(0, "a"), (1, "b"), (2, "c")]
    assert rows(readers.joined_text(articles, " [PAR] ")) == [(0, "one x [PAR] two y"), (1, "three z"), (2, "four")]
    assert readers.paragraphs(articles, True).filter("doc_id = 2").first().context == "[ c ] four"
    assert readers.contexts_questions(articles).count() == 4
    assert [r.doc_id for r in readers.numbered_corpus(spark, str(folder), 0, 2, 1000).orderBy("doc_id").collect()] == [0, 1, 1000]
    (tmp_path / "qa.json").write_text(json.dumps({"data": [{"id": "1", "question": "who is [MASK] .", "answers": ["x", "y"]}]}))
    assert readers.questions(spark, str(tmp_path / "qa.json")).first().question == "who is _"
    (tmp_path / "t.xml").write_text('<topics><topic number="1"><query>q</query><question>why so</question></topic></topics>')
    assert rows(readers.topics(spark, str(tmp_path / "t.xml"))) == [("1", "why so")]
    (tmp_path / "prior.json").write_text(json.dumps([{"question": "q", "cord_uid": ["a", "b"], "score": [1.0, 2.0]}]))
    assert rows(readers.prior_scores(spark, str(tmp_path / "prior.json"))) == [("q", "a", 1.0), ("q", "b", 2.0)]
    (tmp_path / "vocab").write_text("a\nb\na\n")
    assert readers.vocabulary(spark, str(tmp_path / "vocab")) == {"a": 2, "b": 1}
    (tmp_path / "cand").write_text(" Yes \nyes\n\n")
    assert rows(readers.candidates(spark, str(tmp_path / "cand"))) == [("yes",)]
    (tmp_path / "best").write_text("head\n1 | aspirin | 2.5 | 3\n@@@12###text one\n@@@13###text two\n2 | zinc | 1 | 0\n")
    assert [tuple(r)[1:] for r in readers.entity_results(spark, str(tmp_path / "best")).orderBy("rank").collect()] == [(1, "aspirin", 2.5, 3, ["12", "13"], ["text one", "text two"]), (2, "zinc", 1.0, 0, [], [])]
    (tmp_path / "ex.json").write_text(json.dumps({"data": [{"id": "1", "question": "q", "question_entities": {"d": [{"id": "i", "start": 0, "end": 1}, {"id": "i", "start": 2, "end": 3}]}}]}))
    assert rows(readers.examples(spark, str(tmp_path / "ex.json"))) == [("1", "q", ["i"])]
    (tmp_path / "cache.json").write_text(json.dumps({"data": {"1": {"phrases": [{"answer": "x", "score": 1.0}]}}}))
    assert rows(readers.cached_answers(spark, str(tmp_path / "cache.json"), "phrases")) == [("1", 0, "x", 1.0)]
    assert readers.requests(spark, ["a", "b"]).count() == 2


def test_sinks_and_stream(spark, tmp_path):
    phrases = spark.createDataFrame([(1, "a"), (1500, "b")], "doc_id long, v string")
    writers.write_phrases(phrases, str(tmp_path / "p"))
    writers.write_phrases(spark.createDataFrame([(1501, "c")], "doc_id long, v string"), str(tmp_path / "p"))
    assert [r.v for r in spark.read.parquet(str(tmp_path / "p")).orderBy("doc_id").collect()] == ["a", "c"]
    answers = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "qid long, rank int, answer string")
    assert rows(writers.responses(answers)) == [(1, '{"ret":[{"rank":1,"answer":"a"},{"rank":2,"answer":"b"}]}')]
    docs = spark.createDataFrame([(1, "red fox"), (2, "dog")], ingest.DOCUMENT)
    docs.write.parquet(str(tmp_path / "in"))
    for text in (None, "blue fox"):
        if text:
            spark.createDataFrame([(1, text)], ingest.DOCUMENT).write.mode("append").parquet(str(tmp_path / "in"))
        ingest.keep_counts(ingest.watch(spark, str(tmp_path / "in")), str(tmp_path / "c"), str(tmp_path / "ck")).awaitTermination()
    assert {(r.doc_id, r.term) for r in ingest.current_counts(spark, str(tmp_path / "c")).collect()} == {(1, "blue"), (1, "fox"), (1, "blue fox"), (2, "dog")}


def test_nothing_outside_llm_imports_it():
    from pathlib import Path

    root = Path(catalogue.__file__).parent
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "lexigrove.llm" in p.read_text()]
    assert X.STOPWORDS and len(X.STOPWORDS) == len(set(X.STOPWORDS)) == 162
