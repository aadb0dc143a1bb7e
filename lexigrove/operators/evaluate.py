"""Scores of predictions: exact match, token F1, recall, reciprocal rank, precision, TREC lines, sets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrove.functions.arrays import scanned
from lexigrove.functions.text import matches_pattern, nfd, normalize_answer

CLOSED = ("yes", "no", "noanswer")


def token_f1(prediction: Column, truth: Column) -> Column:
    """Struct (f1, precision, recall) of normalised words; closed answers must be equal.

    The multiset intersection is the intersection of words numbered among their equals.
    """

    def numbered(words: Column) -> Column:
        def step(at: Column, w: Column) -> tuple[Column, Column]:
            k = F.when(at["w"] == w, at["k"] + 1).otherwise(0)
            return F.struct(w.alias("w"), k.alias("k")), F.concat(w, F.lit(" "), k.cast("string"))

        return scanned(F.array_sort(words), F.struct(F.lit("").alias("w"), F.lit(0).alias("k")), "array<string>", step)

    def scored(x: Column) -> Column:
        pw, tw = (F.filter(F.split(x[k], " "), lambda w: w != "") for k in "pt")
        same = F.size(F.array_intersect(numbered(pw), numbered(tw)))
        closed = (x["p"].isin(*CLOSED) | x["t"].isin(*CLOSED)) & (x["p"] != x["t"])
        return F.struct(F.when(closed, F.lit(0)).otherwise(same).alias("same"), F.size(pw).alias("np"), F.size(tw).alias("nt"))

    def figures(s: Column) -> Column:
        precision, recall = F.try_divide(s["same"], s["np"]), F.try_divide(s["same"], s["nt"])
        pick = lambda c: F.when(s["same"] == 0, F.lit(0.0)).otherwise(c)
        return F.struct(
            pick(2 * precision * recall / F.nullif(precision + recall, F.lit(0.0))).alias("f1"),
            pick(precision).alias("precision"), pick(recall).alias("recall"),
        )

    pair = F.array(F.struct(normalize_answer(prediction).alias("p"), normalize_answer(truth).alias("t")))
    return F.get(F.transform(F.transform(pair, scored), figures), F.lit(0))


def exact_match(prediction: Column, truth: Column) -> Column:
    return normalize_answer(prediction) == normalize_answer(truth)


def nfd_match(prediction: Column, truth: Column) -> Column:
    """Equality after canonical decomposition, with case and punctuation."""
    return nfd(prediction) == nfd(truth)


#: Ways to match a prediction with a truth.
MATCHES: dict[str, Callable[[Column, Column], Column]] = {"exact": exact_match, "nfd": nfd_match, "regex": matches_pattern}


def best_over_truths(
    predictions: DataFrame, truths: DataFrame, top_k: int = 10, match: str | Callable[[Column, Column], Column] = "exact",
) -> DataFrame:
    """qid, em_top1, em_topk, f1_top1, f1_topk: best over predictions up to the rank and over all truths; 0 without any.

    match: a name of MATCHES, or a function of the columns of predictions and truths.
    """
    pairs = predictions.filter(F.col("rank") <= top_k).join(truths, "qid", "left")
    matched = (MATCHES[match] if isinstance(match, str) else match)(F.col("prediction"), F.col("truth"))
    em = F.coalesce(matched, F.lit(False)).cast("int")
    f1 = F.coalesce(token_f1(F.col("prediction"), F.col("truth"))["f1"], F.lit(0.0))
    scored = pairs.select("qid", "rank", em.alias("em"), f1.alias("f1"))
    first = F.col("rank") == 1
    return scored.groupBy("qid").agg(
        F.max(F.when(first, F.col("em")).otherwise(0)).alias("em_top1"), F.max("em").alias("em_topk"),
        F.round(F.max(F.when(first, F.col("f1")).otherwise(0.0)), 6).alias("f1_top1"), F.round(F.max("f1"), 6).alias("f1_topk"),
    )


def sentence_metrics(results: DataFrame, truths: DataFrame, questions: DataFrame, top_k: int = 50) -> DataFrame:
    """qid, recall_1, recall_k, precision_50, mrr: a result matches if it holds a truth, without case. Questions without results score 0."""
    pairs = results.filter(F.col("rank") <= top_k).join(truths, "qid", "left")
    hit = F.coalesce(F.contains(F.lower("sentence"), F.lower("truth")), F.lit(False))
    matched = pairs.withColumn("hit", hit).groupBy("qid", "rank").agg(F.max(F.col("hit").cast("int")).alias("hit"))
    scored = matched.groupBy("qid").agg(
        F.max(F.when(F.col("rank") == 1, F.col("hit")).otherwise(0)).alias("r1"), F.max("hit").alias("rk"),
        (F.sum(F.when(F.col("rank") <= 50, F.col("hit"))) / 50).alias("p50"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"),
    )
    out = questions.select("qid").join(scored, "qid", "left")
    zero = F.lit(0)
    return out.select(
        "qid", F.coalesce("r1", zero).cast("int").alias("recall_1"), F.coalesce("rk", zero).cast("int").alias("recall_k"),
        F.round(F.coalesce("p50", F.lit(0.0)), 6).alias("precision_50"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
    )


def mean_answers(scored: DataFrame) -> DataFrame:
    """One row: questions, and percentages of the scores of best_over_truths."""
    return scored.agg(F.count(F.lit(1)).alias("n"), *[F.round(100 * F.avg(c), 4).alias(c) for c in ("em_top1", "em_topk", "f1_top1", "f1_topk")])


def mean_sentences(scored: DataFrame) -> DataFrame:
    """One row: questions, and means of the scores of sentence_metrics; questions without results count as 0."""
    return scored.agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("recall_1", "recall_k", "precision_50", "mrr")])


def joint_means(answers: DataFrame, supports: DataFrame, key: str = "qid") -> DataFrame:
    """One row: means over all questions of answer scores, support scores (em, f1, precision, recall each) and of both together.

    Joint precision and recall are products. Questions without support scores count as 0 there.
    """
    own = answers.select(key, *[F.col(c).alias(f"a_{c}") for c in ("em", "precision", "recall", "f1")])
    other = supports.select(key, *[F.col(c).alias(f"s_{c}") for c in ("em", "precision", "recall", "f1")])
    rows = own.join(other, key, "left").fillna(0.0).fillna(0)
    p, r = F.col("a_precision") * F.col("s_precision"), F.col("a_recall") * F.col("s_recall")
    joint = {
        "joint_em": F.col("a_em") * F.col("s_em"), "joint_precision": p, "joint_recall": r,
        "joint_f1": F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)),
    }
    single = {name: F.col(f"{k}_{c}") for k, prefix in (("a", ""), ("s", "sp_")) for c in ("em", "f1", "precision", "recall") for name in (prefix + c,)}
    return rows.agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 6).alias(name) for name, c in (single | joint).items()])


def without_answer(predictions: DataFrame, prediction: str = "prediction") -> DataFrame:
    """One row: questions, and those whose best prediction is null or empty."""
    return predictions.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col(prediction), F.lit("")) == "").alias("n_without"))


def set_scores(predicted: Column, truth: Column) -> Column:
    """Struct (em, f1, precision, recall) of two arrays taken as sets."""
    tp = F.size(F.array_intersect(predicted, truth))
    fp, fn = F.size(F.array_except(predicted, truth)), F.size(F.array_except(truth, predicted))
    precision = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
    recall = F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return F.struct((fp + fn == 0).cast("int").alias("em"), f1.alias("f1"), precision.alias("precision"), recall.alias("recall"))


def set_scores_by(members: DataFrame, by: str) -> DataFrame:
    """by, em, f1, precision, recall of the sets of rows that are predicted and true (nulls are neither); rows are counted, not gathered."""
    p, t = F.coalesce("predicted", F.lit(False)), F.coalesce("truth", F.lit(False))
    counts = members.groupBy(by).agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(t & ~p).alias("fn"))
    precision = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return counts.select(
        by, (F.col("fp") + F.col("fn") == 0).cast("int").alias("em"), f1.alias("f1"), precision.alias("precision"),
        recall.alias("recall"),
    )


def trec_lines(ranked: DataFrame, tag: str) -> DataFrame:
    """Lines of a run file; ranks begin at 0."""
    return ranked.select(F.concat_ws(
        " ", F.col("qid").cast("string"), F.lit("Q0"), F.col("doc_id").cast("string"), (F.col("rank") - 1).cast("string"),
        F.format_string("%.6f", F.col("score")), F.lit(tag),
    ).alias("line"))


def key_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of one side only, and on which side they are."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.subtract(b).withColumn("side", F.lit("left")).unionByName(b.subtract(a).withColumn("side", F.lit("right")))
