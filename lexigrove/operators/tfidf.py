"""N-gram TF-IDF: counts, weights, scores of documents for questions.

Only terms of the questions are counted in documents, so what is shuffled follows the
questions' vocabulary; Spark broadcasts that vocabulary where its size allows, and else
joins by shuffle. Ties go to the lower id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrove.functions.text import terms
from lexigrove.operators import counting


#: Terms that are looked up within tasks; more are joined.
LOOKED_UP = 200_000

#: Words in more than one text of so many have their document frequency at hand in all tasks: as many words as such texts hold at most.
COMMON = 2000


#: Questions that are scored together within tasks; larger sets are joined.
QUESTIONS = 4096


def _several(docs: DataFrame, key: str) -> DataFrame:
    """_key: keys of more than one text."""
    return docs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col(key).alias("_key"))


def _counted(docs: DataFrame, key: str, text: str = "text", **how) -> DataFrame:
    """counting.by_text, with the texts of one key as one text's: they are added up, and only where a key has several texts is anything shuffled."""
    several = _several(docs, key)
    if several.isEmpty():
        return counting.by_text(docs, key, text, **how)
    same = docs[key].eqNullSafe(several["_key"])
    out = counting.by_text(docs.join(several, same, "left_anti"), key, text, **how)
    more = counting.by_text(docs.join(several, same, "left_semi"), key, text, **how)
    names = [c for c in more.columns if c not in ("tf", "first")]
    added = more.groupBy(*names).agg(F.sum("tf").alias("tf"))
    if "first" in more.columns:
        order = Window.partitionBy(key, "term").orderBy(F.desc("par_idx"))
        added = added.withColumn("first", (F.row_number().over(order) == 1).cast("long"))
        added = added.filter("first = 1 OR par_idx >= 0")
    return out.unionByName(added)


def term_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 2, mode: str = "any", only: DataFrame | None = None) -> DataFrame:
    """key, term, tf. only: a frame of terms to count."""
    if n > 2 or mode != "any":
        each = docs.select(key, F.explode(terms(F.col(text), n, mode)).alias("term"))
        if only is not None:
            each = each.join(only, "term", "left_semi")
        return each.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    if only is None:
        return _counted(docs, key, text, n=n)
    few = [r["term"] for r in only.select("term").limit(LOOKED_UP + 1).collect()]
    if len(few) <= LOOKED_UP:
        return _counted(docs, key, text, n=n, only=few)
    return _counted(docs, key, text, n=n).join(only, "term", "left_semi").select(key, "term", "tf")


def bucket_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 2, size: int = 1 << 24) -> DataFrame:
    """key, bucket, tf: terms counted by bucket of their seed-0 murmur hash."""
    return _counted(docs, key, text, n=n, size=size)


def document_frequencies(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def idf(df: Column, n_docs: Column) -> Column:
    return F.greatest(F.lit(0.0), F.log((n_docs - df + 0.5) / (df + 0.5)))


def weights(counts: DataFrame, frequencies: DataFrame, size: DataFrame) -> DataFrame:
    """Counts with weight = ln(1 + tf) * idf. size: one row, n_docs."""
    known = frequencies.crossJoin(F.broadcast(size)).select("term", idf(F.col("df"), F.col("n_docs")).alias("idf"))
    return counts.join(known, "term").withColumn("weight", F.log1p(F.col("tf")) * F.col("idf"))


def corpus_size(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("n_docs"))


def doc_scores_all(questions: DataFrame, docs: DataFrame, qid: str = "item_id", did: str = "doc_id", n: int = 2, k: int | None = None) -> DataFrame:
    """qid, doc, score of every document that shares a term of positive weight with the question. k: those after each question's k best may be missing.

    Questions that fit in a task are scored where the texts are; others are joined with the counts.
    """
    asked = term_counts(questions, qid, n=n)
    counted = term_counts(docs, did, n=n, only=asked.select("term").distinct())
    found = document_frequencies(counted).crossJoin(F.broadcast(corpus_size(docs))).select(
        "term", idf(F.col("df"), F.col("n_docs")).alias("idf"),
    ).filter("idf > 0")
    asked = asked.join(found, "term").select(qid, "term", (F.log1p("tf") * F.col("idf") * F.col("idf")).alias("qw"))
    if n <= 2:
        scores = products(asked.withColumnRenamed("qw", "value"), docs, qid, did, n, k=k)
        if scores is not None:
            return scores
    pairs = counted.join(asked, "term").select(qid, did, (F.log1p("tf") * F.col("qw")).alias("part"))
    return pairs.groupBy(qid, did).agg(F.round(F.sum("part"), 6).alias("score"))


def products(asked: DataFrame, docs: DataFrame, qid: str, did: str, n: int = 2, per: float | None = None, k: int | None = None) -> DataFrame | None:
    """counting.products of questions (qid, term, value above 0); None where they are too many for a task, or a key has several texts."""
    rows = asked.select(qid, "term", "value").limit(LOOKED_UP + 1).collect()
    kind = asked.schema[qid].dataType.simpleString()
    place: dict = {}
    listed = [(place.setdefault(r[qid], len(place)), r["term"], r["value"]) for r in rows]
    if not rows or len(rows) > LOOKED_UP or len(place) > QUESTIONS or kind not in ("bigint", "int", "string") or not _several(docs, did).isEmpty():
        return None
    whole = docs.schema[did].dataType.simpleString() == "bigint"
    return counting.products(docs, listed, list(place), (qid, kind, did, "text"), n, per, k=k if whole else None)


def top_k(scores: DataFrame, k: int, by: str = "item_id", tie: str = "doc_id", score: str = "score") -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.desc(score), tie)
    return scores.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)


def top_docs(questions: DataFrame, docs: DataFrame, k: int = 5, prior: DataFrame | None = None, meta_scale: float = 100.0) -> DataFrame:
    scores = doc_scores_all(questions, docs, k=k if prior is None else None)
    if prior is not None:
        scores = blend_prior(scores, prior, meta_scale)
    return top_k(scores, k)


def blend_prior(scores: DataFrame, prior: DataFrame, meta_scale: float = 100.0) -> DataFrame:
    """Adds prior * meta_scale; documents with a prior alone become candidates. Of repeated priors the largest counts."""
    one = prior.groupBy("item_id", "doc_id").agg(F.max("prior").alias("prior"))
    both = scores.join(one, ["item_id", "doc_id"], "full")
    return both.select("item_id", "doc_id", F.round(F.coalesce("score", F.lit(0.0)) + F.coalesce("prior", F.lit(0.0)) * meta_scale, 6).alias("score"))


def requested_scores(scores: DataFrame, requested: DataFrame) -> DataFrame:
    """Scores of requested (item_id, doc_id) pairs; 0 where nothing matches."""
    return requested.join(scores, ["item_id", "doc_id"], "left").select("item_id", "doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def term_weights(docs: DataFrame, n: int = 2, delimiter: str | None = None) -> DataFrame:
    """doc_id, term, tf, weight = ln(1 + tf) * idf of all terms; with a delimiter doc_id, par_idx, term, tf, weight of the paragraphs' terms.

    Common words get their frequency from a table of them, so their counts stay where they are. The others go once by term, where their rows are counted.
    """
    size = corpus_size(docs)
    words = document_frequencies(term_counts(docs, n=1)).crossJoin(F.broadcast(size))
    common = F.broadcast(words.filter(F.col("df") * COMMON > F.col("n_docs")).select("term", "df"))
    how = {"delimiter": delimiter} if delimiter is not None else {}
    known = _counted(docs, "doc_id", n=1, **how).join(common, "term")
    others = _counted(docs, "doc_id", n=n, **how).join(common, "term", "left_anti")
    own = Window.partitionBy("term")
    others = others.withColumn("df", F.sum("first").over(own) if delimiter is not None else F.count(F.lit(1)).over(own))
    names = ["doc_id", *(["par_idx"] if delimiter is not None else []), "term", "tf"]
    rows = known.select(*names, "df").unionByName(others.select(*names, "df"))
    if delimiter is not None:
        rows = rows.filter("par_idx >= 0")
    return rows.crossJoin(F.broadcast(size)).select(*names, (F.log1p("tf") * idf(F.col("df"), F.col("n_docs"))).alias("weight"))


def paragraph_weights(docs: DataFrame, n: int = 2, delimiter: str = "\n") -> DataFrame:
    """doc_id, par_idx, term, tf, weight: terms of paragraphs, weighed by document frequencies of the whole corpus."""
    if n <= 2 and len(delimiter) == 1 and not counting.classes()[ord(delimiter)]:
        return term_weights(docs, n, delimiter)
    paragraphs = docs.select("doc_id", F.posexplode(F.split("text", delimiter)).alias("par_idx", "text"))
    counts = paragraphs.select(
        "doc_id", "par_idx", F.explode(terms(F.col("text"), n)).alias("term"),
    ).groupBy("doc_id", "par_idx", "term").agg(F.count(F.lit(1)).alias("tf"))
    return weights(counts, document_frequencies(term_counts(docs, n=n)), corpus_size(docs))
