"""Packing of token sequences into windows by best-fit decreasing.

Each text becomes its byte-level BPE ids and an end id. Documents longer than a window
are first cut into full windows; the pieces left over go, longest first, into the open
window with the least room that still holds them. Open windows lie in a segment tree
indexed by remaining capacity, so the tightest one is found in logarithmic time.

What stays open at the end of a block is closed by moving the pieces of the emptiest
windows, cut where needed, into the gaps of the others; at most one window of a block is
not full. A block is what one task reads, up to a bounded number of tokens, so there is
no shuffle and memory doesn't grow with the input.

Null and empty texts hold the end id alone. Each row is a document of its own, also if
ids repeat or are null. Sequence ids are unique: the task's number in the high bits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import chunks, encoder
from .shared import arrow

#: Tokens of left-over pieces that are packed together at most.
BLOCK_TOKENS = 1 << 22


class CapacityTree:
    """Segment tree over remaining capacities 0..size; a leaf counts the open windows with that room."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(self.leaves)]

    def put(self, room: int, window: int) -> None:
        self.open[room].append(window)
        at = room + self.leaves
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Room and number of a window with the least room of at least need, taken out; None without one."""
        at = need + self.leaves
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at == 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.leaves
        while at:
            self.count[at] -= 1
            at >>= 1
        return room, self.open[room].pop()


def best_fit_decreasing(lengths: list[int], size: int) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of (piece, first token of it, tokens); only the last window may be less than full where pieces had to be cut."""
    tree, windows, room = CapacityTree(size), [], []
    for piece in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need = lengths[piece]
        found = tree.take(need)
        if found is None:
            windows.append([])
            room.append(size)
            found = (size, len(windows) - 1)
        left, window = found
        windows[window].append((piece, 0, need))
        room[window] = left - need
        if left > need:
            tree.put(left - need, window)
    emptiest = sorted((w for w in range(len(windows)) if room[w]), key=lambda w: (room[w], w))
    fill = 0
    while fill < len(emptiest) - 1:  # the emptiest window's pieces go into the fullest one's gap
        into, source = emptiest[fill], emptiest[-1]
        if not room[into]:
            fill += 1
            continue
        piece, start, n = windows[source].pop()
        moved = min(n, room[into])
        windows[into].append((piece, start + n - moved, moved))
        room[into] -= moved
        room[source] += moved
        if moved < n:
            windows[source].append((piece, start, n - moved))
        if not windows[source]:
            emptiest.pop()
    return [w for w in windows if w]


def pack(
    docs: DataFrame, path: str, size: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, with keep_ids, ids."""
    kind = docs.schema[id_col].dataType.simpleString()
    more = ", ids array<int>" if keep_ids else ""
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * keep_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        base = TaskContext.get().partitionId() << 33
        made = 0
        tails: list[tuple[object, int, int, np.ndarray]] = []  # id, start, tokens of the document, ids

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [[] for _ in names]
            arrays = [pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:7])]
            if keep_ids:
                arrays.append(pa.array([x.tolist() for x in columns[7]], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, names)

        def row(key, start, ids, total, sequence, offset):
            return (key, start, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4")), total, base + sequence, offset, *[ids] * keep_ids)

        def closed() -> list[tuple]:
            nonlocal made, tails
            rows = []
            for window in best_fit_decreasing([len(t[3]) for t in tails], size):
                offset = 0
                for piece, at, n in window:
                    key, start, total, ids = tails[piece]
                    rows.append(row(key, start + at, ids[at : at + n], total, made, offset))
                    offset += n
                made += 1
            tails = []
            return rows

        held, id_type = 0, None
        for batch in batches:
            id_type = batch.column(0).type
            keys, rows = batch.column(0).to_pylist(), []
            for first, texts in chunks(batch.column(1)):
                words, at = bpe.words_of(texts)
                ids = bpe.ids(words)
                bounds = np.r_[0, np.cumsum(bpe.lengths[words])][at].tolist()
                for i in range(len(texts)):
                    own = np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(end_id))
                    total, full = len(own), len(own) // size * size
                    for start in range(0, full, size):
                        rows.append(row(keys[first + i], start, own[start : start + size], total, made, 0))
                        made += 1
                    if full < total:
                        tails.append((keys[first + i], full, total, own[full:].copy()))
                        held += total - full
                if held >= BLOCK_TOKENS:
                    rows += closed()
                    held = 0
                if len(rows) >= 20_000:
                    yield emit(rows)
                    rows = []
            if rows:
                yield emit(rows)
        if tails:
            yield emit(closed())
        bpe.forget()  # workers are used again by other stages

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = arrow(out, run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long{more}")
    return out.withColumnRenamed("id", id_col)
