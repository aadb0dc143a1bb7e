"""Readers. Every path is read by Spark, so any file system that it knows will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ENTITY = "struct<id:string,start:int,end:int>"
ANSWER = "struct<text:string,answer_start:int>"
QA = f"struct<id:string,question:string,answers:array<{ANSWER}>>"
PARAGRAPH = f"struct<context:string,context_sent_idx:array<array<int>>,context_entities:map<string,array<{ENTITY}>>,qas:array<{QA}>>"
ARTICLE = f"struct<title:string,cord_uid:string,pubmed_id:string,publish_time:struct<year:string,month:string>,journal:string,authors:string,paragraphs:array<{PARAGRAPH}>>"


def spread(frame: DataFrame) -> DataFrame:
    """A table of fewer splits than the session has cores, dealt out over all of them; larger tables stay as they are, without a shuffle."""
    cores = frame.sparkSession.sparkContext.defaultParallelism
    splits = frame._jdf.queryExecution().toRdd().getNumPartitions()
    return frame.repartition(cores) if splits < cores else frame


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """One row for each article: file, position and all fields. doc_id follows the sorted paths and the place within.

    Sums over the files before run in one task, with one row for each file: fit for millions of files; numbered_corpus needs no such sums.
    """
    raw = spark.read.schema(f"data array<{ARTICLE}>").option("recursiveFileLookup", "true").json(path, multiLine=True).select(
        F.col("_metadata.file_path").alias("file"), "data",
    )
    sizes = raw.groupBy("file").agg(F.sum(F.size("data")).alias("n"))
    order = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    base = sizes.select("file", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    rows = raw.select("file", F.posexplode("data").alias("pos", "a")).join(base, "file")
    return rows.select((F.col("base") + F.col("pos")).alias("doc_id"), "file", "pos", "a.*")


def numbered_corpus(spark: SparkSession, folder: str, first: int, stop: int, each: int = 1000) -> DataFrame:
    """Articles of the files (or folders of one file) first..stop-1, named by four digits; doc_id = file number * each + place."""
    paths = [f"{folder}/{i:04d}" for i in range(first, stop)]
    raw = spark.read.schema(f"data array<{ARTICLE}>").json(paths, multiLine=True)
    number = F.regexp_extract(F.col("_metadata.file_path"), r"/(\d{4,})(?:/[^/]*)?$", 1).cast("long")
    raw = raw.select(number.alias("number"), F.posexplode("data").alias("pos", "a"))
    return raw.select((F.col("number") * each + F.col("pos")).alias("doc_id"), "a.*")


def paragraphs(articles: DataFrame, append_title: bool = False) -> DataFrame:
    """doc_id, par_idx, context and what belongs to it; with append_title the title in brackets comes first."""
    rows = articles.select("doc_id", "title", F.posexplode("paragraphs").alias("par_idx", "p"))
    head = F.concat(F.lit("[ "), F.col("title"), F.lit(" ] ")) if append_title else F.lit("")
    return rows.select(
        "doc_id", "title", "par_idx", F.concat(head, F.col("p.context")).alias("context"),
        F.col("p.context_sent_idx").alias("sentences"), F.col("p.context_entities").alias("entities"),
        F.col("p.qas").alias("qas"),
    )


def joined_text(articles: DataFrame, separator: str = " ") -> DataFrame:
    """doc_id and the contexts of all paragraphs."""
    return articles.select("doc_id", F.array_join(F.transform("paragraphs", lambda p: p["context"]), separator).alias("text"))


def contexts_questions(articles: DataFrame, boilerplate: str = "") -> DataFrame:
    """Questions of paragraphs with a recoverable answer; one-word questions and those with the boilerplate phrase go."""
    rows = paragraphs(articles).select("doc_id", "par_idx", "context", F.explode("qas").alias("q")).select("doc_id", "par_idx", "context", "q.*")
    rows = rows.filter(F.size(F.split("question", " ")) != 1)
    if boilerplate:
        rows = rows.filter(~F.contains("question", F.lit(boilerplate)))
    return rows.filter(F.exists("answers", lambda a: F.contains(F.col("context"), a["text"])))


def questions(spark: SparkSession, path: str, draft: int | None = None) -> DataFrame:
    """id, question, answers of an evaluation file; a mask at the end becomes a blank."""
    raw = spark.read.schema("data array<struct<id:string,question:string,answers:array<string>>>").json(path, multiLine=True)
    rows = raw.select(F.explode("data").alias("d")).select(
        "d.id", F.replace("d.question", F.lit("[MASK] ."), F.lit("_")).alias("question"), "d.answers",
    )
    return rows.limit(draft) if draft else rows


def topics(spark: SparkSession, path: str) -> DataFrame:
    """qid and question of an XML topic file."""
    return spark.read.format("xml").option("rowTag", "topic").schema("_number string, question string, query string").load(path).select(
        F.col("_number").alias("qid"), "question",
    )


def prior_scores(spark: SparkSession, path: str) -> DataFrame:
    """question, cord_uid, prior of a file of outside scores."""
    raw = spark.read.schema("question string, cord_uid array<string>, score array<double>").json(path, multiLine=True)
    return raw.select(
        "question", F.explode(F.arrays_zip("cord_uid", "score")).alias("z"),
    ).select("question", "z.cord_uid", F.col("z.score").alias("prior"))


def prior_ids(spark: SparkSession, path: str) -> DataFrame:
    """question, pmid, prior of a file of outside result lists by outside ids; the place of an id in the flattened lists orders repeated ones, and every prior is 1."""
    raw = spark.read.schema("question string, pmid array<array<string>>").json(path, multiLine=True)
    rows = raw.select("question", F.posexplode(F.flatten("pmid")).alias("place", "pmid"))
    return rows.groupBy("question", "pmid").agg(F.max("place").alias("place"), F.lit(1.0).alias("prior"))


def line_set(spark: SparkSession, path: str) -> DataFrame:
    """Distinct lines, without white space at their ends, in their own case."""
    return spark.read.text(path).select(F.rtrim("value").alias("line")).distinct()


def phrase_table(spark: SparkSession, path: str, documents: tuple[int, int] | None = None, each: int = 1000) -> DataFrame:
    """Phrases of a partitioned table; of a range of documents [first, stop) only its folders are read."""
    rows = spark.read.parquet(path)
    if documents is None:
        return rows
    first, stop = documents
    own = F.col("doc_id").between(first, stop - 1)
    return rows.filter(F.col("bucket").between(first // each, (stop - 1) // each) & own)


def postings(spark: SparkSession, path: str, ngram: int = 2, size: int | None = None) -> DataFrame:
    """Postings of a folder, whose parameters must be those asked for."""
    row = spark.read.parquet(f"{path}/parameters").first()
    if (row["ngram"], row["hash_size"]) != (ngram, size):
        raise ValueError(f"postings of ngram={row['ngram']}, hash_size={row['hash_size']}; asked for {ngram}, {size}")
    return spark.read.parquet(f"{path}/postings")


def paragraph_postings(spark: SparkSession, path: str, documents: tuple[int, int] | None = None, each: int = 1000) -> DataFrame:
    """Paragraph weights of a partitioned table, by ranges of documents as in phrase_table."""
    return phrase_table(spark, path, documents, each)


def by_head_question(examples: DataFrame) -> DataFrame:
    """Examples of one head question (of equal text without case) as one row: its ids and distinct entity ids."""
    rows = examples.withColumn("entity", F.explode_outer("entity_ids"))
    return rows.groupBy(F.lower("question").alias("question")).agg(
        F.array_sort(F.collect_set("id")).alias("ids"), F.array_sort(F.collect_set("entity")).alias("entity_ids"),
    )


def vocabulary(spark: SparkSession, path: str) -> dict[str, int]:
    """Token to line number; of repeated tokens the last line counts. A vocabulary file is small by nature."""
    lines = spark.read.text(path, wholetext=True).first()
    tokens = (lines["value"] if lines else "").split("\n")
    return {t.strip(): i for i, t in enumerate(tokens) if t or i < len(tokens) - 1}


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Distinct stripped, lower-case lines."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("answer")).filter("answer <> ''").distinct()


def entity_results(spark: SparkSession, path: str) -> DataFrame:
    """rank, entity, score, articles, pmids and abstracts from the line protocol of the entity service, for each file."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.split("value", "\n").alias("lines"))
    rows = text.select("file", F.posexplode(F.slice(F.col("lines"), F.lit(2), F.size("lines"))).alias("i", "line")).filter("trim(line) <> ''")
    detail = F.startswith("line", F.lit("@@@"))
    group = Window.partitionBy("file").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("g", F.sum((~detail).cast("int")).over(group))
    field = F.split("line", r" \| ")
    heads = rows.filter(~detail).select(
        "file", "g", F.trim(field[0]).cast("int").alias("rank"), F.trim(field[1]).alias("entity"),
        F.trim(field[2]).cast("double").alias("score"), F.trim(field[3]).cast("int").alias("articles"),
    )
    part = F.split(F.trim(F.substring("line", 4, 1 << 30)), "###")
    body = rows.filter(detail).groupBy("file", "g").agg(F.array_sort(F.collect_list(F.struct(
        "i", part[0].alias("pmid"), part[1].alias("abstract"),
    ))).alias("d"))
    none = F.array().cast("array<string>")
    out = heads.join(body, ["file", "g"], "left")
    return out.select(
        "file", "rank", "entity", "score", "articles", F.coalesce(F.transform("d", lambda x: x["pmid"]), none).alias("pmids"),
        F.coalesce(F.transform("d", lambda x: x["abstract"]), none).alias("abstracts"),
    )


def examples(spark: SparkSession, path: str) -> DataFrame:
    """id, question, distinct entity ids of example questions."""
    raw = spark.read.schema(f"data array<struct<id:string,question:string,question_entities:map<string,array<{ENTITY}>>>>").json(path, multiLine=True)
    rows = raw.select(F.explode("data").alias("d")).select("d.*")
    ids = F.array_distinct(F.filter(F.transform(F.flatten(F.map_values("question_entities")), lambda e: e["id"]), lambda i: i.isNotNull()))
    return rows.select("id", "question", F.coalesce(ids, F.array().cast("array<string>")).alias("entity_ids"))


def cached_answers(spark: SparkSession, path: str, source: str, answer: str = "struct<answer:string,score:double>") -> DataFrame:
    """Question id, rank and answer of a file of cached results; source: the field that holds a kind of answers."""
    raw = spark.read.schema(f"data map<string,struct<{source}:array<{answer}>>>").json(path, multiLine=True)
    return raw.select(F.explode("data").alias("qid", "v")).select("qid", F.posexplode(f"v.{source}").alias("rank", "a")).select("qid", "rank", "a.*")


def requests(spark: SparkSession, batch: list[str]) -> DataFrame:
    """A batch of questions as qid and text."""
    return spark.createDataFrame(list(enumerate(batch)), "qid long, text string")
