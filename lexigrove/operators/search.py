"""Stages of phrase search: candidates, reranking, end selection, filters, one answer for each article."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrove.functions.vector import dot


def best_documents(doc_scores: DataFrame, doc_top_k: int = 5) -> DataFrame:
    """The documents of largest score of each question."""
    order = Window.partitionBy("qid").orderBy(F.desc("doc_score"), "doc_id")
    return doc_scores.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= doc_top_k).select("qid", "doc_id", "doc_score")


def phrases_of(starts: DataFrame, questions: DataFrame, documents: DataFrame, digits: int = 6) -> DataFrame:
    """qid, doc_id, start_idx, dense of the phrases of some documents of each question (qid, doc_id), which are scored by no other question.

    starts: doc_id, start_idx, start_vec. questions: qid, query.
    """
    asked = documents.select("qid", "doc_id").join(questions.select("qid", "query"), "qid")
    pairs = starts.select("doc_id", "start_idx", "start_vec").join(asked, "doc_id")
    return pairs.select("qid", "doc_id", "start_idx", F.round(dot(F.col("query"), F.col("start_vec")), digits).alias("dense"))


def sparse_first(phrases: DataFrame, doc_scores: DataFrame, doc_top_k: int = 5, sparse_weight: float = 0.05) -> DataFrame:
    """All phrases of the best documents of each question. phrases: qid, doc_id, start_idx, dense."""
    return phrases.join(best_documents(doc_scores, doc_top_k), ["qid", "doc_id"]).select(
        "qid", "doc_id", "start_idx", F.round(F.col("dense") + sparse_weight * F.col("doc_score"), 9).alias("score"),
    )


def dense_first(phrases: DataFrame, doc_scores: DataFrame, start_top_k: int = 1000, sparse_weight: float = 0.05) -> DataFrame:
    """The phrases of largest inner product; document scores are added after that cut."""
    order = Window.partitionBy("qid").orderBy(F.desc("dense"), "doc_id", "start_idx")
    best = phrases.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= start_top_k)
    scored = best.join(doc_scores, ["qid", "doc_id"], "left")
    return scored.select(
        "qid", "doc_id", "start_idx",
        F.round(F.col("dense") + sparse_weight * F.coalesce("doc_score", F.lit(0.0)), 9).alias("score"),
    )


def hybrid(phrases: DataFrame, doc_scores: DataFrame, start_top_k: int = 1000, doc_top_k: int = 5, sparse_weight: float = 0.05) -> DataFrame:
    """Candidates of both ways; those that both find stay twice."""
    return dense_first(phrases, doc_scores, start_top_k, sparse_weight).unionByName(sparse_first(phrases, doc_scores, doc_top_k, sparse_weight))


def keep_top(candidates: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id", "start_idx")
    return candidates.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)


def token_match(questions: DataFrame, passages: DataFrame, key: str = "token") -> DataFrame:
    """Sum of products of values over all pairs of equal tokens of a question (qid) and a passage (pid)."""
    q = questions.select("qid", F.col(key).alias("t"), F.col("value").alias("qv"))
    p = passages.select("pid", F.col(key).alias("t"), F.col("value").alias("pv"))
    return q.join(p, "t").groupBy("qid", "pid").agg(F.round(F.sum(F.col("qv") * F.col("pv")), 6).alias("score"))


def bigram_ids(ids: Column, size: int = 30522) -> Column:
    """a * size + b of neighbours."""
    wide = F.transform(ids, lambda x: x.cast("long"))
    return F.zip_with(
        F.slice(wide, 1, F.greatest(F.size(ids) - 1, F.lit(0))), F.slice(wide, 2, F.greatest(F.size(ids) - 1, F.lit(0))),
        lambda a, b: a * size + b,
    )


def select_ends(starts: DataFrame, ends: DataFrame, max_answer_length: int = 20, span_weight: float = 1.0) -> DataFrame:
    """For each start the end of largest score. starts: qid, group, start_idx, score, end_query, span (array by distance); ends: group, end_idx, end_vec."""
    near = starts.select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(max_answer_length - 1))).alias("step"),
    ).withColumn("end_idx", F.col("start_idx") + F.col("step"))
    pairs = near.join(ends, ["group", "end_idx"], "left")
    total = F.round(
        F.col("score") + dot(F.col("end_query"), F.col("end_vec")) + span_weight * F.coalesce(F.get("span", F.col("step")), F.lit(0.0)),
        6,
    )
    best = F.max_by(F.struct("end_idx", total.alias("total")), F.struct(total, -F.col("end_idx")))
    chosen = pairs.groupBy("qid", "group", "start_idx").agg(
        F.first("score").alias("score"), F.max(F.when(F.col("end_vec").isNotNull(), 1)).alias("any"), best.alias("b"),
    )
    return chosen.select(
        "qid", "group", "start_idx", "score", F.when(F.col("any") == 1, F.col("b.end_idx")).alias("end_idx"),
        F.when(F.col("any") == 1, F.col("b.total")).alias("end_score"),
    )


def among_candidates(predictions: DataFrame, candidates: DataFrame, prediction: str = "prediction") -> DataFrame:
    """predictions, empty where the text is in the candidates (answer) neither as it is nor in lower case."""
    known = candidates.select("answer").distinct()
    raw = known.select(F.col("answer").alias(prediction), F.lit(True).alias("_raw"))
    low = known.select(F.col("answer").alias("_low"), F.lit(True).alias("_in"))
    rows = predictions.withColumn("_low", F.lower(prediction)).join(raw, prediction, "left").join(low, "_low", "left")
    kept = F.when(F.coalesce("_raw", "_in", F.lit(False)), F.col(prediction)).otherwise("")
    return rows.withColumn(prediction, kept).select(*predictions.columns)


def with_metadata(rows: DataFrame, metadata: DataFrame, key: str, missing: str = "NaN") -> DataFrame:
    """rows with what is known by key, as text; missing values and rows without any get the mark."""
    names = [c for c in metadata.columns if c != key]
    found = rows.join(metadata, key, "left")
    return found.select(*rows.columns, *[F.coalesce(F.col(c).cast("string"), F.lit(missing)).alias(c) for c in names])


def runs(rows: DataFrame, by: str, order: tuple[str, ...], value: str) -> DataFrame:
    """rows with run: a number within by, one more where the value is not that of the row before."""
    within = Window.partitionBy(by).orderBy(*order)
    begins = F.when(F.col(value) == F.lag(value).over(within), 0).otherwise(1)
    return rows.withColumn("_begins", begins).withColumn(
        "run", F.sum("_begins").over(within.rowsBetween(Window.unboundedPreceding, 0)),
    ).drop("_begins")


def documents_asked(candidates: DataFrame) -> DataFrame:
    """For each question the number of its documents and their mean score."""
    return candidates.groupBy("qid").agg(F.countDistinct("doc_id").alias("n_docs"), F.round(F.avg("score"), 4).alias("mean_score"))


def valid_answers(answers: DataFrame, longest: int = 500, least: float = -1e5) -> DataFrame:
    return answers.filter((F.col("score") > least) & (F.col("end_pos") - F.col("start_pos") + 1 < longest))


def without_noise(answers: DataFrame, questions: int = 3, exclamations: int = 5) -> DataFrame:
    """Answers whose context has no more question and exclamation marks than given."""
    many = lambda c: F.length("context") - F.length(F.replace(F.col("context"), F.lit(c), F.lit("")))
    return answers.filter((many("?") <= questions) & (many("!") <= exclamations))


def best_of_article(answers: DataFrame, by: str = "article", order: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The best answer of each question and article, ranked anew."""
    first = Window.partitionBy("qid", by).orderBy(F.desc("score"), *order)
    again = Window.partitionBy("qid").orderBy(F.desc("score"), *order)
    best = answers.withColumn("r", F.row_number().over(first)).filter("r = 1").drop("r")
    return best.withColumn("rank", F.row_number().over(again).cast("long"))


def known_questions(turns: DataFrame) -> DataFrame:
    """turns with n_known: conversations but the own one in which a user asked the same, without case.

    Conversations are counted for each text, and the own one is taken off, so a common question joins with one row.
    """
    asked = turns.filter("role = 'user'").select("conv_id", F.xxhash64(F.lower("text")).alias("h"), F.lower("text").alias("k")).distinct()
    counts = asked.groupBy("h", "k").agg(F.count(F.lit(1)).alias("n"))
    own = asked.select("conv_id", "h", "k", F.lit(1).alias("own"))
    rows = turns.withColumns({"h": F.xxhash64(F.lower("text")), "k": F.lower("text")})
    rows = rows.join(counts, ["h", "k"], "left").join(own, ["conv_id", "h", "k"], "left")
    return rows.withColumn("n_known", F.coalesce("n", F.lit(0)) - F.coalesce("own", F.lit(0))).drop("h", "k", "n", "own")


def filter_phrases(phrases: DataFrame, threshold: float) -> DataFrame:
    """Phrases whose logit is above the threshold, with a compact index; orig_idx keeps the place."""
    order = Window.partitionBy("doc_id").orderBy("orig_idx")
    return phrases.filter(F.col("logit") > threshold).withColumn("idx", (F.row_number().over(order) - 1).cast("long"))


def remap_ends(pairs: DataFrame, ends: DataFrame) -> DataFrame:
    """Original end places as compact ones; -1 where the end was filtered out."""
    known = ends.select("doc_id", F.col("orig_idx").alias("end_orig"), F.col("idx").alias("end_idx"))
    return pairs.join(known, ["doc_id", "end_orig"], "left").withColumn("end_idx", F.coalesce("end_idx", F.lit(-1).cast("long")))
