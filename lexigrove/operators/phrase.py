"""Phrase tables: tokens of windows, starts and their ends, masks of token ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrove.functions.vector import dot

#: The first id that stands for text, and the id of the question mark word piece.
FIRST_TEXT_ID, QUESTION_MARK_ID = 999, 1029


def text_ids(input_id: Column, of_question: bool = False) -> Column:
    """Whether an id stands for text; in questions the question mark does not."""
    own = input_id >= FIRST_TEXT_ID
    return own & (input_id != QUESTION_MARK_ID) if of_question else own


def bigram_values(values: Column) -> Column:
    """The values of a sequence that its bigrams have: all but the last."""
    return F.slice(values, 1, F.greatest(F.size(values) - 1, F.lit(0)))


def window_offsets(windows: DataFrame) -> DataFrame:
    """windows (doc_id, window_idx, n) with the bounds [first, last) of each in the document's concatenated tokens."""
    order = Window.partitionBy("doc_id").orderBy("window_idx")
    until = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long")
    return windows.withColumn("last", until).withColumn("first", F.col("last") - F.col("n"))


def window_of(starts: DataFrame, offsets: DataFrame) -> DataFrame:
    """starts (doc_id, start_idx) with the window that holds each."""
    inside = (starts["start_idx"] >= offsets["first"]) & (starts["start_idx"] < offsets["last"])
    return starts.join(offsets, (starts["doc_id"] == offsets["doc_id"]) & inside).select(starts["*"], "window_idx", "first", "last")


def assembled(windows: DataFrame, longest: int = 20) -> DataFrame:
    """One row for each token of the windows (doc_id, window_idx, tokens): its place in the document, its window and the end places that an answer from it may have.

    Tokens of overlapping windows stay in each of them; answers never cross windows.
    """
    bounds = window_offsets(windows.select("doc_id", "window_idx", F.size("tokens").alias("n"))).select("doc_id", "window_idx", "first", "last")
    each = windows.select("doc_id", "window_idx", F.posexplode("tokens").alias("pos", "token")).join(bounds, ["doc_id", "window_idx"])
    place = (F.col("first") + F.col("pos")).cast("long")
    ends = F.sequence(place, F.least(place + longest, F.col("last")) - 1)
    return each.select("doc_id", "window_idx", place.alias("idx"), "token", ends.alias("start2end"))


def with_examples(features: DataFrame, examples: DataFrame, key: str = "example_index") -> DataFrame:
    """Windows with what is known of their examples."""
    return features.join(examples, key)


def document_numbers(rows: DataFrame, by: str, order: tuple[str, ...], first: Column) -> DataFrame:
    """rows with document: a running number within by, one more at each row that begins a document."""
    running = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("document", F.sum(first.cast("int")).over(running).cast("long"))


def ends_through(starts: DataFrame, ends: DataFrame, max_answer_length: int = 20, span_weight: float = 1.0) -> DataFrame:
    """For each start the end of largest score among the places that its start2end names; null where all are masked (-1).

    starts: qid, doc_id, start_idx, score, end_query, start2end, span (both by distance). ends: doc_id, end_idx, end_vec.
    """
    near = starts.select(
        "qid", "doc_id", "start_idx", "score", "end_query", "span",
        F.posexplode_outer(F.slice("start2end", 1, max_answer_length)).alias("step", "end_idx"),
    )
    pairs = near.withColumn("end_idx", F.when(F.col("end_idx") >= 0, F.col("end_idx"))).join(ends, ["doc_id", "end_idx"], "left")
    total = F.round(
        F.col("score") + dot(F.col("end_query"), F.col("end_vec")) + span_weight * F.coalesce(F.get("span", F.col("step")), F.lit(0.0)),
        6,
    )
    known = F.col("end_vec").isNotNull()
    best = F.max_by(F.struct("end_idx", total.alias("total")), F.when(known, F.struct(total, -F.col("end_idx"))))
    chosen = pairs.groupBy("qid", "doc_id", "start_idx").agg(F.first("score").alias("score"), best.alias("b"))
    return chosen.select("qid", "doc_id", "start_idx", "score", F.col("b.end_idx").alias("end_idx"), F.col("b.total").alias("end_score"))


def answers_in_windows(windows: DataFrame, answers: DataFrame) -> DataFrame:
    """Windows (doc_id, window, start, stop) that hold a document's answer (first, last token) whole, with its places within."""
    inside = (F.col("first") >= F.col("start")) & (F.col("last") < F.col("stop"))
    return windows.join(answers, "doc_id").filter(inside).select(
        "doc_id", "window", (F.col("first") - F.col("start")).alias("first"), (F.col("last") - F.col("start")).alias("last"),
    )


def known_entities(rows: DataFrame, entity: str, asked: str) -> DataFrame:
    """rows with asked_for: whether the entity's id is among those of the question."""
    return rows.withColumn("asked_for", F.coalesce(F.array_contains(asked, F.col(entity)), F.lit(False)))
