"""Model inputs from word pieces, samples of the corpus, priors by document, cached pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrove.operators.windows import window_bounds


def piece_ids(pieces: Column, vocab: dict[str, int]) -> Column:
    """Ids of pieces; a piece that the vocabulary lacks is an error."""
    table = F.create_map(*[F.lit(x) for pair in vocab.items() for x in pair])
    return F.transform(
        pieces,
        lambda p: F.coalesce(F.try_element_at(table, p), F.raise_error(F.concat(F.lit("not in the vocabulary: "), p)).cast("int")),
    )


def question_inputs(questions: DataFrame, vocab: dict[str, int], most: int = 64) -> DataFrame:
    """qid, input_ids, input_mask: pieces between [CLS] and [SEP], cut to most, padded to most + 2."""
    cut = F.concat(F.array(F.lit("[CLS]")), F.slice("pieces", 1, most), F.array(F.lit("[SEP]")))
    rows = questions.select("qid", piece_ids(cut, vocab).alias("ids"))
    gap = F.lit(most + 2) - F.size("ids")
    return rows.select(
        "qid", F.concat("ids", F.array_repeat(F.lit(0), gap)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), F.size("ids")), F.array_repeat(F.lit(0), gap)).alias("input_mask"),
    )


def context_inputs(contexts: DataFrame, vocab: dict[str, int], max_seq_length: int = 512, stride: int = 128) -> DataFrame:
    """doc_id, window_idx, start, input_ids of sliding windows between [CLS] and [SEP]. contexts: doc_id, pieces."""
    rows = contexts.select("doc_id", "pieces", F.explode(window_bounds(F.size("pieces"), max_seq_length - 2, stride)).alias("w"))
    part = F.concat(
        F.array(F.lit("[CLS]")), F.slice(F.col("pieces"), F.col("w.start") + 1, F.col("w.stop") - F.col("w.start")),
        F.array(F.lit("[SEP]")),
    )
    return rows.select("doc_id", F.col("w.window").alias("window_idx"), F.col("w.start").alias("start"), piece_ids(part, vocab).alias("input_ids"))


def sample_vectors(vectors: DataFrame, doc_fraction: float, vector_fraction: float, seed: int = 29) -> DataFrame:
    """Vectors with replacement from a share of the documents, for training an index."""
    docs = vectors.select("doc_id").distinct().sample(withReplacement=False, fraction=doc_fraction, seed=seed)
    return vectors.join(docs, "doc_id", "left_semi").sample(withReplacement=True, fraction=vector_fraction, seed=seed)


def draft(questions: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """The first n rows, or n random ones."""
    return questions.limit(n) if seed is None else questions.orderBy(F.rand(seed)).limit(n)


def priors_by_document(priors: DataFrame, articles: DataFrame, key: str = "cord_uid") -> DataFrame:
    """question, doc_id, prior: outside ids that the corpus has; of articles with the same id the last counts."""
    known = articles.groupBy(key).agg(F.max("doc_id").alias("doc_id"))
    return priors.join(known, key).select("question", "doc_id", "prior")


def unique_titles(articles: DataFrame) -> DataFrame:
    """Titles with a number after all but the first of their kind."""
    order = Window.partitionBy("title").orderBy("doc_id")
    n = F.row_number().over(order)
    return articles.withColumn("unique_title", F.when(n == 1, F.col("title")).otherwise(F.concat(F.col("title"), F.lit("_"), (n - 2).cast("string"))))


#: Keys of one block, whose rows of one value are numbered in one task.
KEYS_EACH = 1 << 20


def numbered_copies(rows: DataFrame, by: str, key: str = "doc_id") -> DataFrame:
    """key, copy (number among the rows of the same value), first_doc and last_doc.

    Values that occur once, nearly all, are told by counts of their hashes; only the others are numbered.
    Values aren't shuffled but 128 bits of each. A frequent value's rows are numbered in blocks of keys, after running sums over the blocks.
    key: a whole number.
    """
    hashed = rows.select(key, F.xxhash64(by).alias("h1"), F.xxhash64(F.lit(1), F.col(by)).alias("h2"))
    groups = hashed.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_doc"), F.max(key).alias("last_doc"))
    some = hashed.join(groups.filter("n > 1").drop("n"), ["h1", "h2"]).withColumn("block", F.floor(F.col(key) / KEYS_EACH))
    counts = some.groupBy("h1", "h2", "block").agg(F.count(F.lit(1)).alias("c"))
    earlier = Window.partitionBy("h1", "h2").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("h1", "h2", "block", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("offset"))
    order = Window.partitionBy("h1", "h2", "block").orderBy(key)
    some = some.withColumn("r", F.row_number().over(order) - 1).join(offsets, ["h1", "h2", "block"])
    some = some.select(key, (F.col("r") + F.col("offset")).cast("long").alias("copy"), "first_doc", "last_doc")
    alone = groups.filter("n = 1").select(F.col("first_doc").alias(key), F.lit(0).cast("long").alias("copy"), "first_doc", "last_doc")
    return some.unionByName(alone)


def cached_page(answers: DataFrame, most: int = 3) -> DataFrame:
    """The answers of a cached question that its page shows."""
    return answers.filter(F.col("rank") < most)


def entity_request(question: Column, kind: Column, top: int, base: str, codes: dict[str, int], fixed: str) -> Column:
    """Address of a request to an entity service. fixed: parameters that every request has, up to the one of the entity type."""
    code = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in codes.items() for x in (k, str(v))]), F.lower(kind)), F.lit(""))
    return F.concat(F.lit(base), F.lit(fixed), code, F.lit(f"&rows={top}&q="), F.replace(F.url_encode(question), F.lit("+"), F.lit("%20")))


def cache_name(url: Column, etag: Column | None = None) -> Column:
    """File name of a cached address: hashes of the address and, after a dot, of its tag."""
    name = F.sha2(url.cast("binary"), 256)
    return name if etag is None else F.when(etag.isNull(), name).otherwise(F.concat(name, F.lit("."), F.sha2(etag.cast("binary"), 256)))


def split_address(address: Column) -> Column:
    """Struct (scheme, bucket, key) of an address; a missing part is empty."""
    rest = F.substring_index(address, "://", -1)
    bucket = F.substring_index(rest, "/", 1)
    return F.struct(
        F.when(F.contains(address, F.lit("://")), F.substring_index(address, "://", 1)).otherwise("").alias("scheme"),
        bucket.alias("bucket"), F.substring(rest, F.length(bucket) + 2, F.length(rest)).alias("key"),
    )


def extension(path: Column, dot: bool = True) -> Column:
    """What follows the last dot of a path's last part, in lower case, with the dot or without."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$" if dot else r"\.([^./]*)$", 1))


def field(row: str, *path: str) -> Column:
    """A nested field by its path."""
    return F.col(".".join((row, *path)))
