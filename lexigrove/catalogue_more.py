"""More queries over the driver's tables: evaluation means, phrase tables, stores, readers, encoders, the whole search.

Readers and stores get small files, or whole tables, written to a shared folder before.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrove.catalogue import _D, _DOCS, _F1, _Q, _SCORES, _TOKEN, _TURNS, ORACLES, _asked_vectors, _grams, _normal, _scores, _t, _top, _turns, query
from lexigrove.functions import text as X
from lexigrove.functions import vector as V
from lexigrove.operators import counting, encode, evaluate, features, index_store, phrase, search, tfidf, vindex, windows
from lexigrove.plans import answer
from lexigrove.sources import readers, scratch, writers

# --- evaluation ------------------------------------------------------------------------------

_PAIRS = f"""{_TURNS}, np AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) r, {_normal("answer")} p FROM turns), nt AS (SELECT conv_id, turn k, {_normal("question")} t FROM turns),
pw AS (SELECT conv_id, r, w, count(*) c FROM (SELECT conv_id, r, unnest(string_split(p, ' ')) w FROM np) WHERE w <> '' GROUP BY ALL), tw AS (SELECT conv_id, k, w, count(*) c FROM (SELECT conv_id, k, unnest(string_split(t, ' ')) w FROM nt) WHERE w <> '' GROUP BY ALL),
pn AS (SELECT conv_id, r, sum(c) n FROM pw GROUP BY ALL), tn AS (SELECT conv_id, k, sum(c) n FROM tw GROUP BY ALL), s AS (SELECT conv_id, r, k, sum(least(pw.c, tw.c)) s FROM pw JOIN tw USING (conv_id, w) GROUP BY ALL),
f AS (SELECT conv_id, r, (p = t)::INT em, CASE WHEN s IS NULL OR ((p IN ('yes', 'no', 'noanswer') OR t IN ('yes', 'no', 'noanswer')) AND p <> t) THEN 0.0 ELSE 2.0 * s / (pn.n + tn.n) END f1
FROM np JOIN nt USING (conv_id) LEFT JOIN s USING (conv_id, r, k) LEFT JOIN pn USING (conv_id, r) LEFT JOIN tn USING (conv_id, k) WHERE r <= 10),
best AS (SELECT conv_id qid, max(CASE WHEN r = 1 THEN em ELSE 0 END) em_top1, max(em) em_topk, round(max(CASE WHEN r = 1 THEN f1 ELSE 0.0 END), 6) f1_top1, round(max(f1), 6) f1_topk FROM f GROUP BY conv_id)"""


def _best(spark, d, match="exact"):
    """Each conversation's answers as ranked predictions; its questions are the truths."""
    turns = _turns(spark, d)
    order = Window.partitionBy("conv_id").orderBy("turn")
    predictions = turns.select(F.col("conv_id").alias("qid"), F.row_number().over(order).alias("rank"), F.col("answer").alias("prediction"))
    return evaluate.best_over_truths(predictions, turns.select(F.col("conv_id").alias("qid"), F.col("question").alias("truth")), 10, match)


@query(f"WITH {_PAIRS} SELECT qid, em_top1 = 1 em_top1, em_topk = 1 em_top10, f1_top1, f1_topk f1_top10 FROM best")
def best_over_truths(spark, d):
    return writers.prediction_rows(_best(spark, d), 10)


@query(f"WITH {_PAIRS} SELECT count(*) n, {', '.join(f'round(100 * avg({c}), 4) {c}' for c in ('em_top1', 'em_topk', 'f1_top1', 'f1_topk'))} FROM best")
def answer_means(spark, d):
    return evaluate.mean_answers(_best(spark, d))


@query("""WITH t AS (SELECT a.conv_id, a.text q, b.text a, row_number() OVER (PARTITION BY a.conv_id ORDER BY a.turn) r FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'),
m AS (SELECT x.conv_id, x.r, max(CASE WHEN nfc_normalize(x.a) = nfc_normalize(y.q) THEN 1 ELSE 0 END) em FROM t x JOIN t y ON x.conv_id = y.conv_id WHERE x.r <= 10 GROUP BY ALL)
SELECT conv_id qid, max(CASE WHEN r = 1 THEN em ELSE 0 END) em_top1, max(em) em_topk FROM m GROUP BY conv_id""")
def nfd_match_turns(spark, d):
    return _best(spark, d, "nfd").select("qid", "em_top1", "em_topk")


@query("SELECT doc_id, nfc_normalize(text) = nfc_normalize(lower(text)) is_lower FROM documents")
def nfd_match_lower(spark, d):
    rows = _t(spark, d, "documents")
    return rows.select("doc_id", evaluate.nfd_match(F.col("text"), F.lower("text")).alias("is_lower"))


@query(f"""WITH {_TURNS}, p AS (SELECT conv_id, turn, answer, regexp_extract(question, '[A-Za-z]+') w FROM turns) SELECT conv_id, turn, regexp_matches(answer, '(?i)^(?:' || w || '[a-z]*,? )') matches FROM p""")
def pattern_match(spark, d):
    pattern = F.concat(F.regexp_extract("question", "[A-Za-z]+", 0), F.lit("[a-z]*,? "))
    return _turns(spark, d).select("conv_id", "turn", X.matches_pattern(F.col("answer"), pattern).alias("matches"))


_SENTENCES = ORACLES["sentence_recall_mrr"]


def _sentence_scores(spark, d) -> DataFrame:
    docs, questions = _t(spark, d, "documents"), _t(spark, d, "benchmark")
    ranked = tfidf.top_docs(questions, docs, 50).join(
        docs.select("doc_id", F.col("text").alias("sentence")), "doc_id",
    ).withColumnRenamed("item_id", "qid")
    asked = questions.select(F.col("item_id").alias("qid"), F.col("text").alias("truth"))
    return evaluate.sentence_metrics(ranked, asked, asked)


@query(f"SELECT count(*) n, {', '.join(f'round(avg({c}), 6) {c}' for c in ('recall_1', 'recall_k', 'precision_50', 'mrr'))} FROM ({_SENTENCES})")
def sentence_means(spark, d):
    return evaluate.mean_sentences(_sentence_scores(spark, d))


@query(f"SELECT qid, recall_1 = 1 recall_1, recall_k = 1 recall_k, printf('%.3f', precision_50) prec_k, printf('%.3f', mrr) mrr_k FROM ({_SENTENCES})")
def sentence_rows(spark, d):
    return writers.sentence_rows(_sentence_scores(spark, d))


@query(f"""WITH {_F1}, a AS (SELECT conv_id, turn, (p = t)::INT em, CASE WHEN s IS NULL OR ((p IN ('yes', 'no', 'noanswer') OR t IN ('yes', 'no', 'noanswer')) AND p <> t) THEN 0 ELSE s END s, np, nt, p, t FROM f),
b AS (SELECT em, CASE WHEN s = 0 THEN 0.0 ELSE s / np END pr, CASE WHEN s = 0 THEN 0.0 ELSE s / nt END re, list_distinct(list_filter(string_split(p, ' '), lambda w: length(w) > 4)) x, list_distinct(list_filter(string_split(t, ' '), lambda w: length(w) > 4)) y FROM a),
c AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0.0 END f, len(list_intersect(x, y)) tp, len(x) nx, len(y) ny FROM b),
e AS (SELECT *, (nx = tp AND ny = tp)::INT sem, CASE WHEN nx > 0 THEN tp / nx ELSE 0.0 END sp, CASE WHEN ny > 0 THEN tp / ny ELSE 0.0 END sr FROM c), g AS (SELECT *, CASE WHEN sp + sr > 0 THEN 2 * sp * sr / (sp + sr) ELSE 0.0 END sf, pr * sp jp, re * sr jr FROM e)
SELECT count(*) n, round(avg(em), 6) em, round(avg(f), 6) f1, round(avg(pr), 6) "precision", round(avg(re), 6) recall, round(avg(sem), 6) sp_em, round(avg(sf), 6) sp_f1, round(avg(sp), 6) sp_precision, round(avg(sr), 6) sp_recall,
round(avg(em * sem), 6) joint_em, round(avg(CASE WHEN jp + jr > 0 THEN 2 * jp * jr / (jp + jr) ELSE 0.0 END), 6) joint_f1, round(avg(jp), 6) joint_precision, round(avg(jr), 6) joint_recall FROM g""")
def joint_means(spark, d):
    """Answers as predictions of questions; their longer words stand for support facts."""
    rows = _turns(spark, d).withColumn("qid", F.struct("conv_id", "turn"))
    p, t = F.col("answer"), F.col("question")
    answers = rows.select("qid", evaluate.exact_match(p, t).cast("int").alias("em"), evaluate.token_f1(p, t).alias("s")).select("qid", "em", "s.*")
    facts = lambda c: F.array_distinct(F.filter(F.split(X.normalize_answer(c), " "), lambda w: F.length(w) > 4))
    supports = rows.select("qid", evaluate.set_scores(facts(p), facts(t)).alias("s")).select("qid", "s.*")
    return evaluate.joint_means(answers, supports)


@query(f"SELECT count(*) n, count(*) FILTER (WHERE answer = '') n_without FROM ({ORACLES['candidate_semi_filter']})")
def no_answer_count(spark, d):
    rows = _t(spark, d, "conversations")
    known = rows.filter("role = 'user'").select(F.lower(F.trim("text")).alias("answer"))
    return evaluate.without_answer(search.among_candidates(rows.select("conv_id", "turn", F.col("text").alias("prediction")), known))


# --- phrase tables ---------------------------------------------------------------------------

_WIN = f"""tok AS (SELECT doc_id, regexp_extract_all(text, '{_TOKEN}') t FROM documents), cnt AS (SELECT doc_id, t, len(t) n, CASE WHEN len(t) <= 64 THEN 1 ELSE 1 + ceil((len(t) - 64) / 48.0)::BIGINT END k FROM tok WHERE len(t) > 0),
win AS (SELECT doc_id, t, i, i * 48 lo, least(i * 48 + 64, n) hi FROM (SELECT doc_id, t, n, unnest(range(k)) i FROM cnt)), off AS (SELECT *, (sum(hi - lo) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT last FROM win)"""


def _cut(spark, d) -> DataFrame:
    """Windows of 64 tokens, 48 apart: doc_id, window_idx, start, stop, tokens."""
    docs = _t(spark, d, "documents").select("doc_id", X.tokens(F.col("text")).alias("t"))
    rows = docs.select("doc_id", "t", F.explode(windows.window_bounds(F.size("t"), 64, 48)).alias("w"))
    own = F.slice("t", F.col("w.start") + 1, F.col("w.stop") - F.col("w.start"))
    return rows.select(
        "doc_id", F.col("w.window").cast("long").alias("window_idx"), F.col("w.start").cast("long").alias("start"),
        F.col("w.stop").cast("long").alias("stop"), own.alias("tokens"),
    )


@query(f"WITH {_WIN} SELECT doc_id, i::BIGINT window_idx, last - (hi - lo) AS \"first\", last AS \"last\" FROM off")
def window_prefix_sums(spark, d):
    rows = phrase.window_offsets(_cut(spark, d).select("doc_id", "window_idx", F.size("tokens").alias("n")))
    return rows.select("doc_id", "window_idx", "first", "last")


@query(f"WITH {_WIN}, s AS (SELECT doc_id, unnest(range(0, max(last), 50)) start_idx FROM off GROUP BY doc_id) SELECT s.doc_id, start_idx::BIGINT start_idx, i::BIGINT window_idx FROM s JOIN off ON s.doc_id = off.doc_id AND start_idx >= last - (hi - lo) AND start_idx < last")
def start_windows(spark, d):
    offsets = phrase.window_offsets(_cut(spark, d).select("doc_id", "window_idx", F.size("tokens").alias("n")))
    starts = offsets.groupBy("doc_id").agg(F.max("last").alias("n")).select(
        "doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(50).cast("long"))).alias("start_idx"),
    )
    return phrase.window_of(starts, offsets).select("doc_id", "start_idx", "window_idx")


@query(f"WITH {_WIN}, e AS (SELECT doc_id, i, last, last - (hi - lo) fst, unnest(t[lo + 1:hi]) token, generate_subscripts(t[lo + 1:hi], 1) - 1 pos FROM off) SELECT doc_id, i::BIGINT window_idx, count(*) n, sum(fst + pos)::BIGINT places, sum(length(token))::BIGINT chars, sum(least(fst + pos + 20, last) - fst - pos)::BIGINT n_ends FROM e GROUP BY doc_id, i")
def phrase_metadata(spark, d):
    rows = phrase.assembled(_cut(spark, d))
    return rows.groupBy("doc_id", "window_idx").agg(
        F.count(F.lit(1)).alias("n"), F.sum("idx").alias("places"), F.sum(F.length("token")).alias("chars"),
        F.sum(F.size("start2end")).cast("long").alias("n_ends"),
    )


@query(f"""WITH e AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 pos, ({_D})[1:32] s, ({_D})[33:64] e FROM embeddings), q AS (SELECT label, s qs, e qe FROM e WHERE pos = 0),
c AS (SELECT a.label, a.pos start_idx, round(list_inner_product(a.s, qs), 6) score, b.pos end_idx, round(round(list_inner_product(a.s, qs), 6) + list_inner_product(b.e, qe) + 0.5 * (b.pos - a.pos) / 10.0, 6) t
FROM e a JOIN q USING (label) LEFT JOIN e b ON a.label = b.label AND b.pos BETWEEN a.pos AND a.pos + 9 AND b.pos % 3 = 0 AND a.pos % 7 <> 0)
SELECT label doc_id, start_idx, score, end_idx, t end_score FROM c QUALIFY row_number() OVER (PARTITION BY label, start_idx ORDER BY t DESC NULLS LAST, end_idx) = 1""")
def ends_through_start2end(spark, d):
    """Every third vector of a label is an end; every seventh start has none."""
    order = Window.partitionBy("label").orderBy("vec_id")
    rows = _t(spark, d, "embeddings").withColumn("pos", (F.row_number().over(order) - 1).cast("long"))
    rows = rows.select(F.col("label").alias("doc_id"), "pos", F.slice("embedding", 1, 32).alias("s"), F.slice("embedding", 33, 32).alias("e"))
    asked = rows.filter("pos = 0").select("doc_id", F.col("s").alias("qs"), F.col("e").alias("qe"))
    steps = F.sequence(F.lit(0), F.lit(14))
    named = F.transform(
        steps,
        lambda k: F.when(((F.col("pos") + k) % 3 == 0) & (F.col("pos") % 7 != 0), F.col("pos") + k).otherwise(F.lit(-1).cast("long")),
    )
    starts = rows.join(asked, "doc_id").select(
        F.lit(0).alias("qid"), "doc_id", F.col("pos").alias("start_idx"), F.round(V.dot(F.col("s"), F.col("qs")), 6).alias("score"), F.col("qe").alias("end_query"),
        named.alias("start2end"), F.transform(steps, lambda k: k / 10.0).alias("span"),
    )
    return phrase.ends_through(starts, rows.select("doc_id", F.col("pos").alias("end_idx"), F.col("e").alias("end_vec")), 10, 0.5).drop("qid")


@query("""WITH p AS (SELECT doc_id, generate_subscripts(p, 1) - 1 par_idx FROM (SELECT doc_id, string_split(text, chr(10)) p FROM documents))
SELECT doc_id, par_idx::BIGINT par_idx, (sum(CASE WHEN par_idx = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id // 1000 ORDER BY doc_id, par_idx))::BIGINT document FROM p""")
def document_breaks(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("par_idx", "p"))
    rows = rows.select("doc_id", F.col("par_idx").cast("long").alias("par_idx"), writers.bucket_of(F.col("doc_id")).alias("file"))
    return phrase.document_numbers(rows, "file", ("doc_id", "par_idx"), F.col("par_idx") == 0).select("doc_id", "par_idx", "document")


@query(f"""WITH i AS (SELECT doc_id, list_transform(regexp_extract_all(text, '{_TOKEN}'), lambda w: 989 + 10 * length(w)) ids FROM documents)
SELECT doc_id, len(list_filter(ids, lambda x: x >= 999))::BIGINT n_context, len(list_filter(ids, lambda x: x >= 999 AND x <> 1029))::BIGINT n_question,
coalesce(list_sum(list_transform(range(1, len(ids)), lambda k: ids[k] * 30522 + ids[k + 1])), 0)::BIGINT bigrams, coalesce(list_sum(ids[1:len(ids) - 1]), 0)::BIGINT trimmed FROM i""")
def token_ids(spark, d):
    ids = F.transform(X.tokens(F.col("text")), lambda w: 989 + 10 * F.length(w))
    rows = _t(spark, d, "documents").select("doc_id", ids.alias("ids"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    size = lambda of_question: F.size(F.filter("ids", lambda x: phrase.text_ids(x, of_question))).cast("long")
    return rows.select(
        "doc_id", size(False).alias("n_context"), size(True).alias("n_question"),
        total(search.bigram_ids(F.col("ids"))).alias("bigrams"), total(phrase.bigram_values(F.col("ids"))).alias("trimmed"),
    )


@query(f"WITH {_WIN}, a AS (SELECT doc_id, n // 2 f, n // 2 + 4 l FROM cnt) SELECT doc_id, i::BIGINT AS \"window\", (f - lo)::BIGINT AS \"first\", (l - lo)::BIGINT AS \"last\" FROM win JOIN a USING (doc_id) WHERE f >= lo AND l < hi")
def answers_in_windows(spark, d):
    cut = _cut(spark, d).withColumnRenamed("window_idx", "window")
    half = F.floor(F.size(X.tokens(F.col("text"))) / 2)
    return phrase.answers_in_windows(cut, _t(spark, d, "documents").select("doc_id", half.alias("first"), (half + 4).alias("last")))


@query(f"SELECT conv_id, turn, list_contains(regexp_extract_all(lower(text), '{_TOKEN}'), 'the') asked_for FROM conversations")
def known_entities(spark, d):
    rows = _t(spark, d, "conversations").select("conv_id", "turn", F.lit("the").alias("entity"), X.tokens(F.lower("text")).alias("asked"))
    return phrase.known_entities(rows, "entity", "asked").select("conv_id", "turn", "asked_for")


@query(f"""WITH p AS (SELECT doc_id, regexp_split_to_array(text, '{_TOKEN}') p, regexp_extract_all(text, '{_TOKEN}') w FROM documents), e AS (SELECT doc_id, unnest(p) b, unnest(list_append(w, NULL)) w, unnest(list_append(p[2:], NULL)) a, generate_subscripts(p, 1) i FROM p),
o AS (SELECT *, sum(length(b) + coalesce(length(w), 0)) OVER (PARTITION BY doc_id ORDER BY i) hi FROM e) SELECT doc_id, count(*) n, sum(hi)::BIGINT ends, sum(hi - length(w))::BIGINT starts, md5(rtrim(string_agg(w || a, '' ORDER BY i))) text_md5 FROM o WHERE w IS NOT NULL GROUP BY doc_id""")
def token_spans(spark, d):
    rows = _t(spark, d, "documents").filter(F.col("text").rlike(X.TOKEN))
    rows = rows.select("doc_id", X.gaps(F.col("text")).alias("p"), X.tokens(F.col("text")).alias("w"))
    rows = rows.select("doc_id", X.spans(F.col("p"), F.col("w")).alias("t"))
    total = lambda c: F.aggregate("t", F.lit(0).cast("long"), lambda s, x: s + x[c])
    text = X.untokenized(F.transform("t", lambda x: x["text"]), F.transform("t", lambda x: x["after"]))
    return rows.select(
        "doc_id", F.size("t").cast("long").alias("n"), total("end").alias("ends"), total("start").alias("starts"),
        F.md5(text.cast("binary")).alias("text_md5"),
    )


# --- model inputs ----------------------------------------------------------------------------

_ENDS = "[aeiou][nrst]"


ORACLES["wordpiece_tokens"] = f"""WITH b AS (SELECT doc_id, strip_accents(lower(regexp_replace(text, '[\\p{{C}}&&[^\\t\\n\\r]]', '', 'g'))) t FROM documents),
w AS (SELECT doc_id, unnest(regexp_extract_all(t, '[!-/:-@\\[-`{{-~\\p{{P}}]|[^!-/:-@\\[-`{{-~\\p{{P}}\\s\\p{{Z}}]+')) w FROM b)
SELECT d.doc_id, coalesce(sum(CASE WHEN w IS NULL THEN 0 WHEN length(w) > 100 OR NOT regexp_full_match(w, '[a-z0-9.,!?|%&$*#:;''"()@+/=_ß-]+') THEN 1 ELSE 1 + len(regexp_extract_all(substr(w, 2), '{_ENDS}|.')) END), 0)::BIGINT n_pieces
FROM documents d LEFT JOIN w USING (doc_id) GROUP BY d.doc_id""".replace("[\\p{C}&&[^\\t\\n\\r]]", "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F\\p{Cf}\\x{FFFD}]")


def _letter_shares(texts: list[str]) -> np.ndarray:
    """An encoder by rule: how often each of eight letters occurs, and the length."""
    return np.array([[*(t.count(c) for c in "etaoinsr"), len(t)] for t in texts], np.float64).reshape(len(texts), 9)


@query("SELECT item_id, " + ", ".join(f"(length(text) - length(replace(text, '{c}', '')))::DOUBLE {c}_count" for c in "etao") + ", length(text)::DOUBLE n FROM benchmark")
def encoder_plugin(spark, d):
    rows = encode.encoded(_t(spark, d, "benchmark"), _letter_shares)
    parts = rows.select("item_id", encode.phrase_vectors(F.col("vector"), 1).alias("v"))
    return parts.select(
        "item_id", *[F.get("v.start", F.lit(i)).alias(f"{c}_count") for i, c in enumerate("etao")],
        F.get("v.span", F.lit(0)).alias("n"),
    )


@query(f"SELECT conv_id, turn, round(list_sum({_D}), 6) total FROM conversations c LEFT JOIN (SELECT lower(text) k, min(item_id) item_id FROM benchmark GROUP BY 1) b ON lower(c.text) = b.k LEFT JOIN embeddings e ON e.vec_id = b.item_id")
def query_vectors(spark, d):
    known = _t(spark, d, "benchmark").groupBy(F.lower("text").alias("question")).agg(F.min("item_id").alias("vec_id")).join(_t(spark, d, "embeddings"), "vec_id")
    rows = _t(spark, d, "conversations").withColumn("question", F.lower("text"))
    found = encode.query_vectors(rows, known.select("question", "embedding"))
    return found.select("conv_id", "turn", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("total"))


# --- stores ----------------------------------------------------------------------------------


@query("SELECT doc_id // 100 AS bucket, count(*) n, sum(n_chars)::BIGINT chars, count(*) FILTER (WHERE doc_id % 3 = 0) fresh FROM documents WHERE doc_id BETWEEN 150 AND 449 GROUP BY 1")
def phrase_store(spark, d):
    """Written by ranges of documents, some replaced; then a range is read."""
    path = scratch.folder(spark, "phrases")
    rows = _t(spark, d, "documents").select("doc_id", "n_chars", F.lit("old").alias("version"))
    writers.write_phrases(rows, path, 100)
    fresh = rows.filter("doc_id % 3 = 0").withColumn("version", F.lit("new"))
    writers.write_phrases(writers.upsert(rows, fresh), f"{path}-next", 100)
    found = readers.phrase_table(spark, f"{path}-next", (150, 450), 100)
    return found.groupBy(F.col("bucket").cast("long").alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), F.count_if(F.col("version") == "new").alias("fresh"),
    )


@query(f"WITH {_DOCS}, tf AS (SELECT doc_id, term, count(*) tf FROM d_gram GROUP BY ALL) SELECT doc_id, count(*) n_terms, sum(tf)::BIGINT total FROM tf GROUP BY doc_id")
def posting_store(spark, d):
    path = scratch.folder(spark, "postings")
    writers.write_postings(tfidf.term_counts(_t(spark, d, "documents")), path)
    return readers.postings(spark, path).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("tf").alias("total"))


@query("""WITH p AS (SELECT doc_id, unnest(p) t, generate_subscripts(p, 1) - 1 par_idx FROM (SELECT doc_id, string_split(text, chr(10)) p FROM documents)) SELECT doc_id, par_idx::BIGINT par_idx, CASE WHEN doc_id % 2 = 0 THEN 2.0 * length(t) ELSE length(t)::DOUBLE END weight FROM p WHERE doc_id < 400""")
def paragraph_store(spark, d):
    """Paragraphs of even documents are written again, in place of the first."""
    path = scratch.folder(spark, "paragraphs")
    rows = _t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("par_idx", "p"))
    rows = rows.select(
        "doc_id", F.col("par_idx").cast("long").alias("par_idx"), F.lit("n").alias("term"),
        F.length("p").cast("double").alias("weight"),
    )
    writers.write_paragraphs(rows, path, 100)
    writers.write_paragraphs(rows.filter("doc_id % 2 = 0").withColumn("weight", 2 * F.col("weight")), path, 100)
    return readers.paragraph_postings(spark, path, (0, 400), 100).select("doc_id", "par_idx", "weight")


@query(f"""WITH {_Q}, e AS (SELECT vec_id, label, list_transform(list_transform({_D}, lambda x: round_even(least(greatest((x + 2.0) * 20.0, -128.0), 127.0), 0)), lambda q: q / 20.0 - 2.0) v FROM embeddings WHERE vec_id % 7 <> 3),
parts AS (SELECT label, unnest({_D}) x, generate_subscripts(embedding, 1) i FROM embeddings), cent AS (SELECT label, list(x ORDER BY i) c FROM (SELECT label, i, avg(x) x FROM parts GROUP BY ALL) GROUP BY label),
probes AS (SELECT qid, query, label FROM (SELECT qid, query, label, round(list_inner_product(query, c), 6) s FROM vq, cent) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY s DESC, label) <= 4),
s AS (SELECT qid, vec_id, round(list_inner_product(query, v), 6) score FROM probes JOIN e USING (label)) {_top("s", 10, "qid", "score DESC, vec_id")}""")
def index_store_search(spark, d):
    """An index by label is built in stages, saved, loaded and searched in its bytes; some ids are left out."""
    vectors = _t(spark, d, "embeddings")
    listed = vectors.withColumnRenamed("label", "cluster_id")
    path = scratch.folder(spark, "index")
    index_store.build(listed, path, vindex.mean_centroids(vectors), stages=("coarse",))
    index_store.build(listed, path, stages=("fine", "add"), ignored=vectors.filter("vec_id % 7 = 3"))
    return index_store.load(spark, path).search(_asked_vectors(spark, d), 10, 4).select("qid", "vec_id", "score", "rank")


@query(f"SELECT round(1.1 * max(sqrt(list_inner_product({_D}, {_D}))), 6) max_norm, count(*) n, count(DISTINCT label) n_lists FROM embeddings")
def index_parameters(spark, d):
    vectors = _t(spark, d, "embeddings")
    path = scratch.folder(spark, "index")
    index_store.build(vectors.withColumnRenamed("label", "cluster_id"), path, vindex.mean_centroids(vectors), norm_factor=1.1)
    found = index_store.load(spark, path)
    return found.lists.agg(
        F.lit(round(found.max_norm, 6)).alias("max_norm"), F.count(F.lit(1)).alias("n"),
        F.countDistinct("cluster_id").alias("n_lists"),
    )


@query(f"SELECT count(*) n, round(sum(list_sum({_D})), 4) total FROM embeddings WHERE sqrt(list_inner_product({_D}, {_D})) <= 1.0")
def within_norm(spark, d):
    rows = vindex.within_norm(_t(spark, d, "embeddings"), 1.0)
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))), 4).alias("total"),
    )


# --- readers ---------------------------------------------------------------------------------


def _saved(frame: DataFrame, name: str) -> str:
    """One text file with the one row of frame."""
    path = scratch.folder(frame.sparkSession, name)
    frame.coalesce(1).write.text(path)
    return path


def _json(rows: DataFrame, name: str, order: str) -> str:
    """Rows as the field data of one JSON document, in order."""
    listed = rows.orderBy(order).agg(F.collect_list(F.struct(*rows.columns)).alias("data"))
    return _saved(listed.select(F.to_json(F.struct("data"))), name)


def _corpus(spark: SparkSession, d: str) -> str:
    """Folder of files of up to 100 documents each, with names of four digits."""
    path = scratch.folder(spark, "corpus")
    paragraphs = F.transform(F.split("text", "\n"), lambda p: F.struct(p.alias("context")))
    rows = _t(spark, d, "documents").select(
        "doc_id", F.lpad(F.floor(F.col("doc_id") / 100).cast("string"), 4, "0").alias("file"),
        F.concat("source", F.lit(" "), "lang").alias("title"),
        F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("cord_uid"), paragraphs.alias("paragraphs"),
    )
    files = rows.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("doc_id", "title", "cord_uid", "paragraphs"))).alias("data"))
    files.select("file", F.to_json(F.struct("data")).alias("value")).repartition("file").write.partitionBy("file").text(path)
    return path


@query("""WITH r AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 i FROM documents) SELECT i doc_id, 'u' || doc_id cord_uid, source || ' ' || lang title, len(string_split(text, chr(10)))::INT n_paragraphs, md5(replace(text, chr(10), ' ')) text_md5 FROM r""")
def corpus_scan(spark, d):
    articles = readers.corpus(spark, _corpus(spark, d))
    text = readers.joined_text(articles)
    return articles.select("doc_id", "cord_uid", "title", F.size("paragraphs").alias("n_paragraphs")).join(
        text.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5")), "doc_id",
    )


@query("""WITH p AS (SELECT doc_id, unnest(p) c, generate_subscripts(p, 1) - 1 par_idx, source || ' ' || lang title FROM (SELECT *, string_split(text, chr(10)) p FROM documents)) SELECT doc_id, par_idx::BIGINT par_idx, md5('[ ' || title || ' ] ' || c) context_md5 FROM p""")
def paragraph_scan(spark, d):
    articles = readers.corpus(spark, _corpus(spark, d)).withColumn("doc_id", F.substring("cord_uid", 2, 20).cast("long"))
    rows = readers.paragraphs(articles, append_title=True)
    return rows.select("doc_id", F.col("par_idx").cast("long").alias("par_idx"), F.md5(F.col("context").cast("binary")).alias("context_md5"))


@query("SELECT (doc_id // 100) * 100 + row_number() OVER (PARTITION BY doc_id // 100 ORDER BY doc_id) - 1 doc_id, 'u' || doc_id cord_uid FROM documents WHERE doc_id BETWEEN 100 AND 199")
def numbered_corpus_scan(spark, d):
    raw = spark.read.schema(f"data array<{readers.ARTICLE}>").json(f"{_corpus(spark, d)}/file=0001", multiLine=True)
    target = scratch.folder(spark, "numbered")
    raw.select(F.to_json(F.struct("data"))).coalesce(1).write.text(f"{target}/0001")
    return readers.numbered_corpus(spark, target, 1, 2, 100).select("doc_id", "cord_uid")


@query("SELECT 'q' || item_id id, replace(text || ' [MASK] .', '[MASK] .', '_') question, 1::INT n_answers FROM benchmark")
def question_scan(spark, d):
    rows = _t(spark, d, "benchmark").select(
        F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("id"),
        F.concat("text", F.lit(" [MASK] .")).alias("question"), F.array("text").alias("answers"),
    )
    return readers.questions(spark, _json(rows, "questions", "id")).select("id", "question", F.size("answers").alias("n_answers"))


@query("SELECT item_id::VARCHAR qid, trim(regexp_replace(text, '[^A-Za-z0-9 ]', '', 'g')) question FROM benchmark")
def topic_scan(spark, d):
    plain = F.trim(F.regexp_replace("text", "[^A-Za-z0-9 ]", ""))
    line = F.concat(
        F.lit('<topic number="'), F.col("item_id").cast("string"), F.lit('"><query>x</query><question>'), plain,
        F.lit("</question></topic>"),
    )
    rows = _t(spark, d, "benchmark").agg(F.concat(
        F.lit("<topics>\n"), F.array_join(F.array_sort(F.collect_list(line)), "\n"), F.lit("\n</topics>"),
    ).alias("value"))
    return readers.topics(spark, _saved(rows, "topics"))


def _priors(spark, d, field: str, value) -> str:
    """One JSON document for each question: the documents whose number follows the question's."""
    n = _t(spark, d, "benchmark").agg(F.count(F.lit(1)).alias("n"))
    rows = _t(spark, d, "labels").crossJoin(F.broadcast(n)).select((F.col("doc_id") % F.col("n")).alias("item_id"), "doc_id", "quality")
    listed = rows.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("doc_id", "quality"))).alias("x"))
    line = F.to_json(F.struct(F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("question"), *value(F.col("x"))))
    path = scratch.folder(spark, field)
    listed.agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(line)), ","), F.lit("]")).alias("value")).coalesce(1).write.text(path)
    return path


@query("SELECT 'q' || (doc_id % (SELECT count(*) FROM benchmark)) question, doc_id, max(quality / 10.0)::DOUBLE prior FROM labels GROUP BY ALL")
def prior_scan(spark, d):
    path = _priors(
        spark, d, "priors",
        lambda x: (F.transform(x, lambda r: F.concat(F.lit("u"), r["doc_id"].cast("string"))).alias("cord_uid"), F.transform(x, lambda r: r["quality"] / F.lit(10.0)).alias("score")),
    )
    articles = _t(spark, d, "documents").select("doc_id", F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("cord_uid"))
    return features.priors_by_document(readers.prior_scores(spark, path), articles)


@query("SELECT 'q' || (doc_id % (SELECT count(*) FROM benchmark)) question, 'p' || doc_id pmid, 1.0::DOUBLE prior FROM labels GROUP BY ALL")
def prior_id_scan(spark, d):
    path = _priors(
        spark, d, "prior-ids",
        lambda x: (F.transform(x, lambda r: F.array(F.concat(F.lit("p"), r["doc_id"].cast("string")))).alias("pmid"),),
    )
    return readers.prior_ids(spark, path).select("question", "pmid", "prior")


@query("WITH l AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 i FROM (SELECT DISTINCT lang FROM documents)) SELECT doc_id, i AS id FROM documents JOIN l USING (lang)")
def vocabulary_scan(spark, d):
    rows = _t(spark, d, "documents")
    words = rows.select("lang").distinct().agg(F.array_join(F.array_sort(F.collect_list("lang")), "\n").alias("value"))
    vocab = readers.vocabulary(spark, _saved(words, "vocabulary"))
    return rows.select("doc_id", F.get(features.piece_ids(F.array("lang"), vocab), F.lit(0)).cast("long").alias("id"))


@query("SELECT DISTINCT lower(trim(text)) answer FROM conversations WHERE role = 'user' AND trim(text) <> '' AND NOT contains(text, chr(10))")
def candidate_scan(spark, d):
    path = scratch.folder(spark, "candidates")
    _t(spark, d, "conversations").filter("role = 'user'").filter(~F.contains("text", F.lit("\n"))).select("text").write.text(path)
    return readers.candidates(spark, path)


@query("SELECT DISTINCT rtrim(text) line FROM conversations WHERE role = 'user' AND NOT contains(text, chr(10))")
def line_set_scan(spark, d):
    path = scratch.folder(spark, "lines")
    _t(spark, d, "conversations").filter("role = 'user'").filter(~F.contains("text", F.lit("\n"))).select("text").write.text(path)
    return readers.line_set(spark, path)


@query("WITH e AS (SELECT lower(text) question, item_id::VARCHAR id, 'e' || (item_id % 3) entity FROM benchmark) SELECT question, array_to_string(list_sort(list_distinct(list(id))), ',') ids, array_to_string(list_sort(list_distinct(list(entity))), ',') entity_ids FROM e GROUP BY question")
def example_scan(spark, d):
    one = F.struct(F.concat(F.lit("e"), (F.col("item_id") % 3).cast("string")).alias("id"), F.lit(0).alias("start"), F.lit(1).alias("end"))
    rows = _t(spark, d, "benchmark").select(
        F.col("item_id").cast("string").alias("id"), F.col("text").alias("question"),
        F.create_map(F.lit("x"), F.array(one)).alias("question_entities"),
    )
    found = readers.by_head_question(readers.examples(spark, _json(rows, "examples", "id")))
    return found.select("question", F.array_join("ids", ",").alias("ids"), F.array_join("entity_ids", ",").alias("entity_ids"))


@query(f"""WITH {_SCORES}, r AS ({_top("scores", 5, "item_id", "score DESC, doc_id")}) SELECT item_id::VARCHAR qid, (rank - 1)::INT rank, 'd' || doc_id answer, score FROM r WHERE rank <= 3""")
def cached_scan(spark, d):
    """The best documents of each question as cached answers; a page shows three of them."""
    rows = tfidf.top_k(_scores(spark, d), 5)
    one = F.struct("rank", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("answer"), "score")
    by = rows.groupBy(F.col("item_id").cast("string").alias("qid")).agg(F.array_sort(F.collect_list(one)).alias("x"))
    entry = F.map_from_entries(F.collect_list(F.struct("qid", F.struct(F.col("x").alias("found")))))
    path = _saved(by.agg(F.to_json(F.struct(entry.alias("data"))).alias("value")), "cache")
    return features.cached_page(readers.cached_answers(spark, path, "found")).select("qid", "rank", "answer", "score")


@query("SELECT item_id::INT rank, 'entity ' || item_id entity, (item_id / 4.0)::DOUBLE score, (item_id % 3)::INT articles, CASE WHEN item_id % 3 > 0 THEN 'p' || item_id ELSE '' END pmids FROM benchmark WHERE item_id > 0")
def entity_protocol_scan(spark, d):
    item = F.col("item_id").cast("string")
    head = F.concat(
        item, F.lit(" | entity "), item, F.lit(" | "), (F.col("item_id") / 4.0).cast("string"), F.lit(" | "),
        (F.col("item_id") % 3).cast("string"),
    )
    body = F.when(F.col("item_id") % 3 > 0, F.concat(head, F.lit("\n@@@p"), item, F.lit("###an abstract"))).otherwise(head)
    rows = _t(spark, d, "benchmark").filter("item_id > 0").agg(F.concat(
        F.lit("rank | name | score | articles\n"), F.array_join(F.collect_list(body), "\n"),
    ).alias("value"))
    found = readers.entity_results(spark, _saved(rows, "entities"))
    return found.select("rank", "entity", "score", "articles", F.array_join("pmids", ",").alias("pmids"))


@query("SELECT item_id qid, text FROM benchmark WHERE item_id < 20")
def request_batch(spark, d):
    """A batch of questions as a request gives them."""
    rows = _t(spark, d, "benchmark").filter("item_id < 20").orderBy("item_id").collect()
    return readers.requests(spark, [r["text"] for r in rows])


@query("SELECT doc_id, text LIKE '%the%' AND len(string_split(text, ' ')) <> 1 keeps FROM documents")
def recoverable_answers(spark, d):
    """Questions whose answer is in the context; here each document asks for the."""
    qas = F.array(F.struct(
        F.col("doc_id").cast("string").alias("id"), F.col("text").alias("question"),
        F.array(F.struct(F.lit("the").alias("text"), F.lit(0).alias("answer_start"))).alias("answers"),
    ))
    paragraph = F.struct(
        F.col("text").alias("context"), F.lit(None).cast("array<array<int>>").alias("context_sent_idx"),
        F.lit(None).cast(f"map<string,array<{readers.ENTITY}>>").alias("context_entities"), qas.alias("qas"),
    )
    docs = _t(spark, d, "documents")
    found = readers.contexts_questions(docs.select("doc_id", F.lit("t").alias("title"), F.array(paragraph).alias("paragraphs")))
    return docs.select("doc_id").join(
        found.select("doc_id", F.lit(True).alias("k")), "doc_id", "left",
    ).select("doc_id", F.coalesce("k", F.lit(False)).alias("keeps"))


# --- queries of catalogue.py whose SQL is long -------------------------------------------------

ORACLES["nfd_terms"] = f"""WITH n AS (SELECT doc_id, nfc_normalize(text) text FROM documents), {_grams("n", "doc_id", "d")}
SELECT documents.doc_id, count(term) n_terms FROM documents LEFT JOIN d_gram USING (doc_id) GROUP BY documents.doc_id"""


def _murmur(term: str) -> str:
    """Seed-0 MurmurHash3 of a text's UTF-8 bytes, from hexadecimal digits; sums and products stay within 64 bits."""
    m = "4294967295"
    word = lambda h, i: f"('0x' || substr({h}, {i} + 6, 2) || substr({h}, {i} + 4, 2) || substr({h}, {i} + 2, 2) || substr({h}, {i}, 2))::UBIGINT"
    turned = lambda x, k: f"((({x} << {k}) & {m}) | ({x} >> {32 - k}))"
    mixed = lambda k: f"list_transform([({k} * 3432918353) & {m}], lambda a: ({turned('a', 15)} * 461845907) & {m})[1]"
    step = f"list_transform([xor(h, x)], lambda b: ({turned('b', 13)} * 5 + 3864292196) & {m})[1]"
    end = lambda h: f"list_transform([xor({h}, {h} >> 16)], lambda c: (c * 2246822507) & {m})[1]"
    last = lambda h: f"list_transform([xor({h}, {h} >> 13)], lambda c: (c * 3266489909) & {m})[1]"
    return f"""d0 AS (SELECT DISTINCT term FROM {term}), d1 AS (SELECT term, hex(encode(term)) h, length(hex(encode(term))) // 2 n FROM d0),
d2 AS (SELECT term, n, list_transform(range(0, n // 4), lambda i: {word("h", "(8 * i + 1)")}) w, rpad(substr(h, 8 * (n // 4) + 1), 8, '0') tail FROM d1),
d3 AS (SELECT term, n, list_transform(w, lambda k: {mixed("k")}) w, {mixed(word("tail", "1"))} t FROM d2),
d4 AS (SELECT term, xor(xor(list_reduce(list_prepend(0::UBIGINT, w), lambda h, x: {step}), CASE WHEN n % 4 > 0 THEN t ELSE 0::UBIGINT END), n::UBIGINT) h FROM d3),
d5 AS (SELECT term, {end("h")} h FROM d4), d6 AS (SELECT term, {last("h")} h FROM d5), hashed AS (SELECT term, xor(h, h >> 16) h FROM d6)"""


ORACLES["hashed_tf"] = f"WITH {_DOCS}, {_murmur('d_gram')} SELECT doc_id, (h % 16777216)::BIGINT bucket, count(*) tf FROM d_gram JOIN hashed USING (term) GROUP BY ALL"


# --- the whole search --------------------------------------------------------------------------

_ANSWERS = f"""WITH {_SCORES}, prior AS (SELECT doc_id % (SELECT count(*) FROM benchmark) item_id, doc_id, max(quality * 0.1) prior FROM labels GROUP BY ALL),
ds AS (SELECT item_id qid, doc_id, round(coalesce(score, 0.0) + coalesce(prior, 0.0) * 10.0, 6) doc_score FROM scores FULL JOIN prior USING (item_id, doc_id)),
vq AS (SELECT b.item_id qid, e.{_D} query FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id), st AS (SELECT vec_id, vec_id doc_id, label cluster_id, label start_idx, {_D} v FROM embeddings),
parts AS (SELECT label, unnest({_D}) x, generate_subscripts(embedding, 1) i FROM embeddings), cent AS (SELECT label, list(x ORDER BY i) c FROM (SELECT label, i, avg(x) x FROM parts GROUP BY ALL) GROUP BY label),
probes AS (SELECT qid, query, label cluster_id FROM (SELECT qid, query, label, round(list_inner_product(query, c), 6) s FROM vq, cent) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY s DESC, label) <= 6),
near AS (SELECT qid, doc_id, start_idx, round(list_inner_product(v, query), 6) dense FROM probes JOIN st USING (cluster_id) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY dense DESC, doc_id) <= 50),
df1 AS (SELECT qid, doc_id, start_idx, round(dense + 0.05 * coalesce(doc_score, 0.0), 9) score FROM near LEFT JOIN ds USING (qid, doc_id)),
sf AS (SELECT qid, doc_id, start_idx, round(round(list_inner_product(v, query), 6) + 0.05 * doc_score, 9) score FROM (SELECT * FROM ds QUALIFY row_number() OVER (PARTITION BY qid ORDER BY doc_score DESC, doc_id) <= 5) JOIN vq USING (qid) JOIN st USING (doc_id)),
al AS (SELECT * FROM df1 UNION SELECT * FROM sf), top AS (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id, start_idx) <= 10),
e1 AS (SELECT t.qid, t.doc_id, t.start_idx, t.score, t.start_idx + k end_idx, round(t.score + list_inner_product(vq.query[1:8], s.v[1 + k:8 + k]), 6) total FROM top t JOIN vq USING (qid) JOIN st s USING (doc_id), unnest([0, 1, 3]) u(k)),
e2 AS (SELECT * FROM e1 QUALIFY row_number() OVER (PARTITION BY qid, doc_id, start_idx ORDER BY total DESC, end_idx) = 1),
w0 AS (SELECT doc_id, unnest(p) w, generate_subscripts(p, 1) i FROM (SELECT doc_id, regexp_split_to_array(text, '[ \t\r\n ]') p FROM documents)), w1 AS (SELECT *, sum(length(w) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(w) - 1 place FROM w0),
tk AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 idx, place lo, place + length(w) hi FROM w1 WHERE w <> ''),
pl AS (SELECT e2.qid, e2.doc_id, e2.start_idx, e2.score, a.lo start_pos, coalesce(b.hi, a.hi) end_pos, d.text, d.source article FROM e2 JOIN tk a ON a.doc_id = e2.doc_id AND a.idx = e2.start_idx LEFT JOIN tk b ON b.doc_id = e2.doc_id AND b.idx = e2.end_idx JOIN documents d ON d.doc_id = e2.doc_id),
ln AS (SELECT doc_id, unnest(p) s, generate_subscripts(p, 1) i FROM (SELECT doc_id, string_split(text, chr(10)) p FROM documents)), sn AS (SELECT *, sum(length(s) + 1) OVER (PARTITION BY doc_id ORDER BY i) hi, sum(length(s) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(s) - 1 lo FROM ln),
ok AS (SELECT pl.*, sn.lo sent_start FROM pl JOIN sn ON sn.doc_id = pl.doc_id AND start_pos >= sn.lo AND start_pos < sn.hi WHERE end_pos - start_pos + 1 < 500),
ba AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY qid, article ORDER BY score DESC, doc_id, start_idx) = 1)
SELECT qid, doc_id, start_idx, start_pos::BIGINT start_pos, end_pos::BIGINT end_pos, sent_start::BIGINT sent_start, substr(text, start_pos::BIGINT + 1, (end_pos - start_pos)::BIGINT) answer, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id, start_idx) rank FROM ba"""


@query(_ANSWERS)
def answer_search(spark, d):
    """Hybrid candidates with priors and probed lists, named ends, sentences, one answer for each source. A vector is a phrase of the document of its number."""
    vectors, docs = _t(spark, d, "embeddings"), _t(spark, d, "documents")
    named = F.array(F.col("label"), F.col("label") + 1, F.lit(-1), F.col("label") + 3)
    starts = vectors.select(
        "vec_id", "embedding", F.col("label").alias("cluster_id"), F.col("vec_id").alias("doc_id"),
        F.col("label").cast("long").alias("start_idx"), F.transform(named, lambda x: x.cast("long")).alias("start2end"),
    )
    ends = vectors.select(
        F.col("vec_id").alias("doc_id"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2), F.lit(3))).alias("k"), "label",
        "embedding",
    )
    ends = ends.select(
        "doc_id", (F.col("label") + F.col("k")).cast("long").alias("end_idx"),
        F.slice(F.col("embedding"), F.col("k") + 1, F.lit(8)).alias("end_vec"),
    )

    def tokens(of):
        return counting.words_between(of).select(
            "doc_id", "idx", F.col("start").alias("char_start"), (F.col("start") + F.length("word")).alias("char_end"),
        )

    n = _t(spark, d, "benchmark").agg(F.count(F.lit(1)).alias("n"))
    prior = _t(spark, d, "labels").crossJoin(F.broadcast(n)).select(
        (F.col("doc_id") % F.col("n")).alias("qid"), "doc_id", (F.col("quality") * F.lit(0.1)).alias("prior"),
    )
    corpus = answer.Corpus(starts, vindex.mean_centroids(vectors), ends, tokens, docs.withColumn("article", F.col("source")), prior=prior)
    asked = _t(spark, d, "benchmark").join(vectors, F.col("item_id") == F.col("vec_id"))
    asked = asked.select(F.col("item_id").alias("qid"), "text", F.col("embedding").alias("query"), F.slice("embedding", 1, 8).alias("end_query"))
    p = answer.parameters("command", strategy="hybrid", start_top_k=50, nprobe=6, aggregate=True)
    return answer.answer_questions(corpus, asked, p=p).select(
        "qid", "doc_id", "start_idx", "start_pos", "end_pos", "sent_start", "answer", "score", "rank",
    )
