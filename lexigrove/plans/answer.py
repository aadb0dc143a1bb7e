"""The whole search: candidates, two cuts with reranking, ends, localisation, filters, one answer for each article."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.operators import phrase, search, tfidf, vindex
from lexigrove.operators.windows import sentence_at, sentences


@dataclass(frozen=True)
class Parameters:
    strategy: str = "dense_first"
    start_top_k: int = 1000
    mid_top_k: int = 100
    top_k: int = 10
    doc_top_k: int = 5
    nprobe: int = 256
    sparse_weight: float = 0.05
    meta_scale: float = 100.0
    max_answer_length: int = 20
    aggregate: bool = False
    drop_noise: bool = False


#: How the entry points differ from Parameters().
ENTRY_POINTS = {
    "command": {"meta_scale": 10.0}, "batch": {"nprobe": 64, "meta_scale": 10.0}, "page": {"aggregate": True}, "request": {"meta_scale": 10.0}, "library": {},
}


def parameters(entry_point: str = "library", **given) -> Parameters:
    """The parameters of an entry point, but for those given."""
    return Parameters(**(ENTRY_POINTS[entry_point] | given))


@dataclass(frozen=True)
class Corpus:
    """What is searched, as frames, and how documents are scored.

    starts: vec_id, embedding, doc_id, start_idx, cluster_id and, where ends are named, start2end and span.
    centroids: cluster_id, centroid. ends: doc_id, end_idx, end_vec. tokens: doc_id, idx, char_start, char_end, or a function that gives them of documents.
    documents: doc_id, text, article. doc_scores: from questions to qid, doc_id, doc_score; without one, scores are TF-IDF.
    prior: qid, doc_id, prior.
    """

    starts: DataFrame
    centroids: DataFrame
    ends: DataFrame
    tokens: DataFrame | Callable[[DataFrame], DataFrame]
    documents: DataFrame
    doc_scores: Callable[[DataFrame], DataFrame] | None = None
    prior: DataFrame | None = None

    def scores(self, questions: DataFrame, meta_scale: float) -> DataFrame:
        if self.doc_scores is not None:
            return self.doc_scores(questions)
        found = tfidf.doc_scores_all(questions.select("qid", "text"), self.documents, "qid")
        if self.prior is not None:
            found = tfidf.blend_prior(
                found.withColumnRenamed("qid", "item_id"), self.prior.withColumnRenamed("qid", "item_id"), meta_scale,
            ).withColumnRenamed("item_id", "qid")
        return found.withColumnRenamed("score", "doc_score")


def candidates(phrases: DataFrame, doc_scores: DataFrame, p: Parameters) -> DataFrame:
    if p.strategy == "dense_first":
        return search.dense_first(phrases, doc_scores, p.start_top_k, p.sparse_weight)
    if p.strategy == "sparse_first":
        return search.sparse_first(phrases, doc_scores, p.doc_top_k, p.sparse_weight)
    if p.strategy == "hybrid":
        return search.hybrid(phrases, doc_scores, p.start_top_k, p.doc_top_k, p.sparse_weight)
    raise ValueError(f"unknown strategy: {p.strategy}")


def found_by(corpus: Corpus, questions: DataFrame, p: Parameters) -> DataFrame:
    """Candidates of questions (qid, text, query): phrases of nprobe lists cut to start_top_k, phrases of the best documents, or both."""
    if p.strategy not in ("dense_first", "sparse_first", "hybrid"):
        raise ValueError(f"unknown strategy: {p.strategy}")
    doc_scores = corpus.scores(questions, p.meta_scale)
    parts = []
    if p.strategy != "sparse_first":
        near = vindex.probed_top_k(corpus.starts, vindex.probe(questions.select("qid", "query"), corpus.centroids, p.nprobe), p.start_top_k)
        near = near.join(corpus.starts.select("vec_id", "doc_id", "start_idx"), "vec_id")
        parts.append(search.dense_first(
            near.select("qid", "doc_id", "start_idx", F.col("score").alias("dense")), doc_scores, p.start_top_k,
            p.sparse_weight,
        ))
    if p.strategy != "dense_first":
        starts = corpus.starts.select("doc_id", "start_idx", F.col("embedding").alias("start_vec"))
        own = search.phrases_of(starts, questions, search.best_documents(doc_scores, p.doc_top_k))
        parts.append(search.sparse_first(own, doc_scores, p.doc_top_k, p.sparse_weight))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def finished(
    found: DataFrame, asked: DataFrame, ends: DataFrame, tokens: DataFrame | Callable[[DataFrame], DataFrame], documents: DataFrame, paragraph_scores: DataFrame | None, p: Parameters
) -> DataFrame:
    """Ranked answers of candidates (qid, doc_id, start_idx, score). asked: qid, doc_id, start_idx, end_query, span and, where ends are named, start2end."""
    keys = ["qid", "doc_id", "start_idx"]
    found = search.keep_top(found.distinct(), p.mid_top_k).drop("rank")
    if paragraph_scores is not None:
        extra = F.round(F.col("score") + F.coalesce("extra", F.lit(0.0)), 6)
        found = found.join(paragraph_scores, keys, "left").withColumn("score", extra).drop("extra")
    found = search.keep_top(found, p.top_k).drop("rank").join(asked, keys)
    if "start2end" in asked.columns:
        ended = phrase.ends_through(found, ends, p.max_answer_length)
    else:
        ended = search.select_ends(
            found.withColumnRenamed("doc_id", "group"), ends.withColumnRenamed("doc_id", "group"), p.max_answer_length,
        ).withColumnRenamed("group", "doc_id")
    if callable(tokens):  # only the documents found are cut into tokens: top_k of each question at most
        documents = documents.join(ended.select("doc_id").distinct(), "doc_id", "left_semi")
        tokens = tokens(documents)
    first = tokens.select("doc_id", F.col("idx").alias("start_idx"), F.col("char_start").alias("start_pos"), F.col("char_end").alias("own_end"))
    last = tokens.select("doc_id", F.col("idx").alias("end_idx"), F.col("char_end").alias("end_pos"))
    placed = ended.join(first, ["doc_id", "start_idx"]).join(last, ["doc_id", "end_idx"], "left").withColumn(
        "end_pos", F.coalesce("end_pos", "own_end"),
    ).drop("own_end")
    placed = placed.join(documents.select("doc_id", F.col("text").alias("context"), "article"), "doc_id")
    placed = placed.withColumn("s", sentence_at(sentences(F.col("context")), F.col("start_pos"), F.length("context")))
    answer = F.substring(F.col("context"), F.col("start_pos") + 1, F.col("end_pos") - F.col("start_pos"))
    placed = placed.select("*", "s.*", answer.alias("answer")).drop("s")
    kept = search.valid_answers(placed)
    if p.drop_noise:
        kept = search.without_noise(kept)
    if p.aggregate:
        return search.best_of_article(kept, "article", ("doc_id", "start_idx"))
    return search.keep_top(kept, p.top_k)


def answers(
    phrases: DataFrame, doc_scores: DataFrame, tokens: DataFrame, documents: DataFrame, ends: DataFrame,
    paragraph_scores: DataFrame | None = None, p: Parameters = Parameters(),
) -> DataFrame:
    """Ranked answers with their places in the text, from phrases that are scored already.

    phrases: qid, doc_id, start_idx, dense, end_query, span. doc_scores: qid, doc_id, doc_score.
    tokens: doc_id, idx, char_start, char_end. documents: doc_id, text, article.
    ends: doc_id, end_idx, end_vec. paragraph_scores: qid, doc_id, start_idx, extra; added between the cuts.
    """
    other = [c for c in ("end_query", "span", "start2end") if c in phrases.columns]
    asked = phrases.select("qid", "doc_id", "start_idx", *other)
    return finished(candidates(phrases, doc_scores, p), asked, ends, tokens, documents, paragraph_scores, p)


def answer_questions(corpus: Corpus, questions: DataFrame, paragraph_scores: DataFrame | None = None, p: Parameters = Parameters()) -> DataFrame:
    """Ranked answers to questions (qid, text, query, end_query) by all stages of the search."""
    known = [F.col(c) if c in corpus.starts.columns else F.array().cast("array<double>").alias(c) for c in ("span",)]
    named = ["start2end"] if "start2end" in corpus.starts.columns else []
    found = found_by(corpus, questions, p)
    asked = found.select("qid", "doc_id", "start_idx").distinct().join(
        corpus.starts.select("doc_id", "start_idx", *known, *named), ["doc_id", "start_idx"],
    )
    asked = asked.join(questions.select("qid", "end_query"), "qid")
    return finished(found, asked, corpus.ends, corpus.tokens, corpus.documents, paragraph_scores, p)
