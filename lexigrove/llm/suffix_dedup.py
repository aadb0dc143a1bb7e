"""Removal of repeated byte strings, by column-wise construction over aligned suffixes.

A byte is removed if a string of LENGTH bytes that covers it also starts anywhere else in the
corpus. Every such string has one minimizer (the leftmost of its least-hashed GRAM-byte strings), at
the same place in all its copies, so the suffixes to compare are those at equal distance from
a common minimizer:

1. Each text is cut into pieces: the strings that share one minimizer. Pieces that occur
   twice are repeated as a whole. This takes counts by minimizer (44 bits) and a 64-bit hash, which combine before a shuffle.
2. Of each distinct piece whose minimizer has other distinct pieces, one copy's bytes are
   gathered by minimizer, aligned on it, and inserted column by column from the right: each
   round puts one symbol of every piece before its suffix, sorts the suffixes by the
   transform of the former column, and updates the common prefixes of neighbours from the
   former ones. A prefix of LENGTH with a neighbour marks a repeated string.
3. Where a minimizer has more than MOST_PIECES distinct pieces, their strings are counted by
   128-bit hashes over all tasks instead.

Null texts count as empty. Strings never cross texts. Rows of the same id and text each count
as a place of their own and get equal results. Only id and text are used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .shared import arrow, drop_table, table, width
from .textwords import mix, pieces

LENGTH, GRAM, MOST_PIECES = 400, 16, 1 << 14
#: Pieces inserted together, about; bytes of one numpy pass, below 2**20.
BATCH_PIECES, PASS_BYTES = 4096, 1 << 18
_BITS = 20
_PAD = 0xFF  # no byte of UTF-8


def _least(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each run of size values, from running minima of blocks forwards and backwards."""
    n = len(values) - size + 1
    padded = np.full(-(-len(values) // size) * size, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, size)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[size - 1 : size - 1 + n])


def cut(data: np.ndarray, at: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """First string of each piece, strings in it, minimizer's place and key. at: where texts begin."""
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    if len(data) < length:
        return none
    n = len(data) - gram + 1
    padded = np.r_[data, np.zeros(16, np.uint8)]
    words = np.ndarray((len(data) + 8,), "<u8", padded, strides=(1,))
    if gram >= 16:
        value = mix(words[:n] * np.uint64(0x9E3779B97F4A7C15) ^ mix(words[gram - 8 : gram - 8 + n], 3), 5)
    else:
        half = np.uint64((1 << 8 * min(gram, 8)) - 1)
        value = mix((words[:n] & half) * np.uint64(0x9E3779B97F4A7C15) ^ mix(words[gram - 8 : gram - 8 + n] if gram > 8 else words[:n] & half, 3), 5)
    value = (value >> np.uint64(_BITS) << np.uint64(_BITS)) | np.arange(n, dtype=np.uint64)
    least = _least(value, length - gram + 1)
    change = np.zeros(len(data) + 1, np.int32)
    long = at[1:] - at[:-1] >= length
    change[at[:-1][long]] += 1
    change[at[1:][long] - length + 1] -= 1
    valid = np.cumsum(change)[: len(least)] > 0
    other = np.r_[True, least[1:] != least[:-1]]
    first = np.flatnonzero(valid & (other | ~np.r_[False, valid[:-1]]))
    last = np.flatnonzero(valid & (np.r_[other[1:], True] | ~np.r_[valid[1:], False]))
    anchor = (least[first] & np.uint64((1 << _BITS) - 1)).astype(np.int64)
    return first, last - first + 1, anchor, (least[first] >> np.uint64(_BITS)).astype(np.int64)


def _cut_all(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy() for i in (0, 1))
            for row, data, at in pieces(batch.column(2), PASS_BYTES):
                for shift in range(0, max(1, len(data) - length + 1), PASS_BYTES - length + 1) if len(data) > PASS_BYTES else (0,):
                    part = data[shift : shift + PASS_BYTES] if len(data) > PASS_BYTES else data
                    bounds = np.array([0, len(part)]) if len(data) > PASS_BYTES else at
                    first, n, anchor, key = cut(part, bounds, length, gram)
                    view = memoryview(np.ascontiguousarray(part))
                    digest = [xxhash.xxh3_64_intdigest(view[a:b]) - (1 << 63) for a, b in zip(first.tolist(), (first + n - 1 + length).tolist())]
                    of = np.searchsorted(bounds, first, "right") - 1
                    place = first - bounds[of] + shift
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(k1[row + of]), pa.array(k2[row + of]), pa.array(key), pa.array(digest, pa.int64()), pa.array(place), pa.array(n), pa.array(anchor - first)],
                        ["k1", "k2", "minimizer", "digest", "place", "n", "anchor"],
                    )

    return run


def repeated_columns(columns: np.ndarray, length: int) -> np.ndarray:
    """columns[c, i]: symbol c of string i. Marks [i, c] where the string of so many symbols from c on is another's, too.

    Rounds go from the last column to the first. order holds the strings sorted by their suffixes
    from the column on, common the prefix each has in common with the one before it.
    """
    width, n = columns.shape
    found = np.zeros((n, max(0, width - length + 1)), bool)
    order, common = np.arange(n), np.zeros(n + 1, np.int32)
    for c in range(width - 1, -1, -1):
        symbol = columns[c][order]
        to = np.argsort(symbol, kind="stable")
        order = order[to]
        symbol = symbol[to]
        pair = np.flatnonzero(symbol[1:] == symbol[:-1])
        before, after = to[pair], to[pair + 1]
        now = np.zeros(n + 1, np.int32)
        if len(pair):
            least = np.minimum.reduceat(common, np.stack([before + 1, after + 1], 1).ravel())[::2]
            now[pair + 1] = np.minimum(least + 1, length)
        common = now
        if c + length <= width:
            hit = np.flatnonzero(common[:n] >= length)
            if len(hit):
                found[order[hit], c] = True
                found[order[hit - 1], c] = True
    return found


_OUT = "k1 long, k2 long, start long, stop long"


def _insert(length: int, gram: int):
    lead = length - gram

    def closed(held: list[tuple]) -> pa.RecordBatch | None:
        columns = np.full((len(held), lead + length), _PAD, np.uint8)
        for i, (_, _, _, anchor, _, _, text) in enumerate(held):
            columns[i, lead - anchor : lead - anchor + len(text)] = np.frombuffer(text, np.uint8)
        found = repeated_columns(np.ascontiguousarray(columns.T), length)
        rows = []
        for i, (k1, k2, place, anchor, n, alone, _) in enumerate(held):
            if alone:
                own = np.r_[False, found[i, lead - anchor : lead - anchor + n], False]
                edge = np.flatnonzero(own[1:] != own[:-1]).tolist()
                rows += [(k1, k2, place + a, place + b - 1 + length) for a, b in zip(edge[::2], edge[1::2])]
        if not rows:
            return None
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["k1", "k2", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last = None
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for key, row in zip(keys, zip(*(c.to_pylist() for c in batch.columns[1:]))):
                if key != last and len(held) >= BATCH_PIECES:
                    if (out := closed(held)) is not None:
                        yield out
                    held = []
                last = key
                held.append(row)
        if held and (out := closed(held)) is not None:
            yield out

    return run


def _each_string(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k1, k2, place, n, alone, text in zip(*(c.to_pylist() for c in batch.columns)):
                view = memoryview(text)
                digest = [xxhash.xxh3_128_digest(view[i : i + length]) for i in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k1] * n, pa.int64()), pa.array([k2] * n, pa.int64()), pa.array(range(place, place + n), pa.int64()), pa.array([alone] * n), pa.array(digest, pa.binary())],
                    ["k1", "k2", "start", "alone", "digest"],
                )

    return run


def _lean(docs: DataFrame, text_col: str) -> bool:
    """Whether the text is put back into the row after the shuffles, which then take it once."""
    return docs.schema[text_col].dataType == StringType()


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with 128 bits that stand for id and text. row has the other columns and, if _lean, of the text only whether it is null."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    mark = F.when(F.col(text_col).isNotNull(), F.lit("")).alias(text_col)
    row = F.struct(*[mark if c == text_col and _lean(docs, text_col) else F.col(c) for c in docs.columns]).alias("row")
    return docs.select(F.xxhash64(F.col(id_col), text).alias("k1"), F.xxhash64(F.lit(9), text, F.col(id_col)).alias("k2"), text.alias("text"), row)


def repeated_spans(keyed: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST_PIECES) -> DataFrame:
    """k1, k2 and spans (start, stop) of bytes to remove; spans may overlap. A table of its own: what led to it is removed."""
    spark = keyed.sparkSession
    texts = keyed.select("k1", "k2", "text")
    cuts = arrow(
        texts.filter(F.octet_length("text") >= length), _cut_all(length, gram),
        "k1 long, k2 long, minimizer long, digest long, place long, n long, anchor long",
    )
    cuts = table(cuts, "pieces")
    counted = cuts.groupBy("minimizer", "digest").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct("k1", "k2", "place", "n", "anchor")).alias("one"),
    )
    counted = table(counted, "counted")
    whole = cuts.join(counted.filter("copies > 1").select("minimizer", "digest"), ["minimizer", "digest"])
    whole = whole.select("k1", "k2", F.col("place").alias("start"), (F.col("place") + F.col("n") - 1 + length).alias("stop"))
    rivals = counted.groupBy("minimizer").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    open_ones = counted.join(rivals, "minimizer").select("minimizer", "kinds", (F.col("copies") == 1).alias("alone"), "one.*")
    strings = texts.join(open_ones, ["k1", "k2"]).select(
        "minimizer", "kinds", "k1", "k2", "place", "anchor", "n", "alone",
        F.substring(F.col("text").cast("binary"), (F.col("place") + 1).cast("int"), (F.col("n") - 1 + length).cast("int")).alias("bytes"),
    )
    strings = table(strings, "strings")
    whole = table(whole, "whole")
    drop_table(cuts)
    drop_table(counted)
    made = [strings, whole]
    few = strings.filter(F.col("kinds") <= most).select("minimizer", "k1", "k2", "place", "anchor", "n", "alone", "bytes")
    few = few.repartition(width(spark), "minimizer").sortWithinPartitions("minimizer")
    spans = whole.unionByName(arrow(few, _insert(length, gram), _OUT))
    many = strings.filter(F.col("kinds") > most)
    if many.limit(1).count():
        each = arrow(
            many.select("k1", "k2", "place", "n", "alone", "bytes"), _each_string(length),
            "k1 long, k2 long, start long, alone boolean, digest binary",
        )
        each = table(each, "each")
        made.append(each)
        twice = each.groupBy("digest").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1").select("digest")
        hot = each.filter("alone").join(twice, "digest")
        spans = spans.unionByName(hot.select("k1", "k2", "start", (F.col("start") + length).alias("stop")))
    spans = table(spans, "spans")
    for one in made:
        drop_table(one)
    return spans


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, start, stop in zip(*(c.to_pylist() for c in batch.columns[:3])):
            raw = text.encode("utf-8", "surrogatepass")
            runs: list[list[int]] = []
            for a, b in sorted(zip(start or (), stop or ())):
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], b)
                else:
                    runs.append([a, b])
            parts, at = [], 0
            for a, b in runs:
                parts.append(raw[at:a])
                at = b
            kept = b"".join([*parts, raw[at:]])
            rows.append((len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
        columns = list(zip(*rows)) or [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        made = [pa.array(c, k) for c, k in zip(columns, kinds)]
        yield pa.RecordBatch.from_arrays([batch.column(3), *made], ["row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def dedup(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST_PIECES, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """row (the input row), n_bytes, n_removed, n_spans, kept_sha256 (of the bytes left) and kept (their text, without parts of cut characters)."""
    keyed = _keyed(docs, id_col, text_col)
    spans = repeated_spans(keyed, length, gram, most)
    gathered = spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    row = F.col("row")
    if _lean(docs, text_col):
        row = row.withField(text_col, F.when(F.col(f"row.{text_col}").isNotNull(), F.col("text"))).alias("row")
    out = keyed.join(gathered, ["k1", "k2"], "left").select("text", F.col("spans.start").alias("start"), F.col("spans.stop").alias("stop"), row)
    kind = keyed.schema["row"].dataType.simpleString()
    return arrow(out, _kept, f"row {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    out = dedup(docs.select(id_col, text_col), id_col=id_col, text_col=text_col)
    return out.select(f"row.{id_col}", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same columns, the repeated bytes taken out of the texts (parts of cut characters too); null texts stay null."""
    out = dedup(docs, id_col=id_col, text_col=text_col)
    text = F.when(F.col(f"row.{text_col}").isNotNull(), F.col("kept"))
    return out.select(*[text.alias(c) if c == text_col else F.col(f"row.{c}").alias(c) for c in docs.columns])
