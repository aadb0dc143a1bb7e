"""Document fingerprints with DataFrame functions only: threshold-scaled sketches.

A sketch keeps every shingle hash (five words; with fewer, the whole sequence) below a
fixed fraction of the hash range. Hashes are the first 64 bits of MD5, so any engine can make
them. Sketches of one fraction are merged by union, and the share of one sketch found in another estimates
containment, also between documents of very unequal length.

Words are runs of other than ASCII white space, with A-Z in lower case. Null texts count
as empty; texts without words have an empty sketch. An empty sketch is like another (1)
only if the texts are equal, and else unlike (0). Equal texts have equal sketches.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import width

WORDS, FRACTION = 5, 0.25
#: Hexadecimal digits of a hash.
DIGITS = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, _UPPER, _LOWER), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def sketch(text: Column, fraction: float = FRACTION) -> Column:
    """Sorted distinct shingle hashes below the fraction, as hexadecimal digits."""
    limit = min(round(fraction * 16**8), 16**8)

    def hashed(shingle: Column) -> Column:
        return F.substring(F.md5(shingle.cast("binary")), 1, DIGITS)

    def shingles(w: Column) -> Column:
        n = F.size(w)
        each = F.transform(F.sequence(F.lit(1), n - WORDS + 1), lambda i: hashed(F.array_join(F.slice(w, i, WORDS), " ")))
        return F.when(n >= WORDS, each).when(n > 0, F.array(hashed(F.array_join(w, " ")))).otherwise(F.array().cast("array<string>"))

    # the one-element transform computes the words once
    made = F.get(F.transform(F.array(words(text)), shingles), F.lit(0))
    if limit < 16**8:
        made = F.filter(made, lambda h: h < F.lit(f"{limit:08x}"))
    return F.array_sort(F.array_distinct(made))


def containment(a: Column, b: Column, same: Column) -> Column:
    """Share of a's hashes that b has too."""
    share = F.size(F.array_intersect(a, b)) / F.size(a)
    return F.when(same, F.lit(1.0)).when(F.size(a) == 0, F.lit(0.0)).otherwise(share).cast("double")


def merge(sketches: DataFrame, by: str, sketch_col: str = "sketch") -> DataFrame:
    """Union of the sketches of each group, pre-aggregated hash by hash."""
    each = sketches.select(by, F.explode(sketch_col).alias("hash")).distinct()
    return each.groupBy(by).agg(F.array_sort(F.collect_list("hash")).alias(sketch_col))


def _borders(keys: DataFrame, parts: int) -> list[tuple]:
    """First key (id as text, hash of the text) of each range of keys that has rows, in order: at most parts rows."""
    ranged = keys.repartitionByRange(parts, F.col("_id").asc_nulls_first(), "_tie").select("_id", "_tie", F.spark_partition_id().alias("p"))
    heads = ranged.groupBy("p").agg(F.min(F.struct("_id", "_tie")).alias("h")).orderBy("p")
    return [(r["i"], r["t"]) for r in heads.select(F.col("h._id").cast("string").alias("i"), F.col("h._tie").alias("t")).collect()]


def with_next(docs: DataFrame, id_col: str, text_col: str, fraction: float) -> DataFrame:
    """Each text with its sketch and those of the next row by id (after the last, the first), with one exchange of the texts.

    Ranges of keys, one for each shuffle partition, become window partitions, and the first row of each range
    goes to the range before it, too. Their borders come from the keys alone. Rows without id come first; rows of one id
    follow the hash of their texts, so a frequent id is dealt out as well.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"),
    ).withColumn("_tie", F.xxhash64("_text"))
    borders = _borders(rows.select("_id", "_tie"), width(spark))
    n = max(1, len(borders))
    kind = docs.schema[id_col].dataType.simpleString()
    key = F.struct("_id", "_tie")
    table = F.from_json(
        F.lit(json.dumps([{"_id": i, "_tie": t} for i, t in borders])), "array<struct<_id:string,_tie:bigint>>",
    ).cast(f"array<struct<_id:{kind},_tie:bigint>>")
    steps = [1 << k for k in reversed(range(max(1, n.bit_length())))]
    # binary search: how many borders but the first are at or before the key
    part = F.aggregate(
        F.array(*[F.lit(s) for s in steps]), F.lit(0),
        lambda at, s: at + F.when((at + s < n) & (F.get(table, at + s) <= key), s).otherwise(0),
    )
    rows = rows.withColumn("_part", part)
    own, before = F.struct(F.col("_part").alias("p"), F.lit(0).alias("s")), F.struct(
        F.pmod(F.col("_part") - 1, F.lit(n)).alias("p"), F.lit(1).alias("s"),
    )
    leads = F.coalesce(F.get(table, F.col("_part")) == key, F.lit(False))
    rows = rows.select("_id", "_text", "_tie", F.explode(F.when(leads, F.array(own, before)).otherwise(F.array(own))).alias("_at"))
    rows = rows.select("_id", "_text", "_tie", F.col("_at.p").alias("_part"), F.col("_at.s").alias("_copy"))
    rows = rows.repartitionById(n, "_part").withColumn("_sketch", sketch(F.col("_text"), fraction))
    order = "(PARTITION BY _part ORDER BY _copy, _id NULLS FIRST, _tie)"
    rows = rows.withColumns({"_next": F.expr(f"lead(_text) OVER {order}"), "_next_sketch": F.expr(f"lead(_sketch) OVER {order}")})
    return rows.filter("_copy = 0")


def fingerprints(docs: DataFrame, fraction: float = FRACTION, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, and of the text whose second half is the next one's beginning, with their likeness."""
    rows = with_next(docs, id_col, text_col, fraction)
    n = F.length("_text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("_edited", F.concat(F.substring(F.col("_text"), F.lit(1), n - half), F.substring(F.col("_next"), F.lit(1), half)))
    rows = rows.withColumn("_edited_sketch", sketch(F.col("_edited"), fraction))
    return rows.select(
        F.col("_id").alias(id_col),
        F.length("_text").cast("long").alias("n_chars"),
        F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        F.array_join("_sketch", "").alias("fingerprint"),
        F.array_join("_edited_sketch", "").alias("edited_fingerprint"),
        containment(F.col("_sketch"), F.col("_edited_sketch"), F.col("_text") == F.col("_edited")).alias("near_edited"),
        containment(F.col("_sketch"), F.col("_next_sketch"), F.col("_text") == F.col("_next")).alias("near_next"),
    )
