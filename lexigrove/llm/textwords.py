"""Words of many texts at once: spans and 64-bit hashes in numpy, over the UTF-8 bytes of an Arrow column."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

CHUNK_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: A value for each byte, so that sums over a word depend on every bit.
VALUES = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64) | np.uint64(1)


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    h = (h ^ np.uint64(salt)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


@functools.lru_cache(4)
def powers(n: int, inverse: bool = False) -> np.ndarray:
    out = np.full(n, pow(_BASE, -1, 1 << 64) if inverse else _BASE, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(18, int(n).bit_length())
    return powers(size + 1), powers(size + 1, True)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts (null: empty), and where each begins (n + 1 places)."""
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def pieces(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes and beginnings of runs of texts with at most so many bytes, or of one text."""
    data, at = flat(column)
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield first, data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def spans(data: np.ndarray, at: np.ndarray, white: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word, and its text's number; words never cross texts."""
    inside = ~white[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    heads = at[:-1][at[:-1] < at[1:]]
    begin[heads] = inside[heads]
    start = np.flatnonzero(begin)
    gap = np.flatnonzero(~inside)
    of = np.searchsorted(at, start, "right") - 1
    next_gap = np.r_[gap, len(data)][np.searchsorted(gap, start)]
    return start, np.minimum(next_gap, at[of + 1]), of


def sums(data: np.ndarray, lower: np.ndarray | None = LOWER) -> np.ndarray:
    """Running sums from which the hash of any span follows."""
    total = np.zeros(len(data) + 1, np.uint64)
    power, _ = _tables(len(data))
    np.cumsum((VALUES[lower] if lower is not None else VALUES)[data] * power[: len(data)], out=total[1:])
    return total


#: Longer words are hashed one by one: running sums modulo 2**64 don't tell all long periodic words apart.
LONG_WORD = 32


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: np.ndarray | None = LOWER) -> np.ndarray:
    """64-bit hash of each word."""
    out = hashes(sums(data, lower), start, end)
    for i in np.flatnonzero(end - start > LONG_WORD).tolist():
        word = data[start[i] : end[i]]
        out[i] = xxhash.xxh3_64_intdigest((word if lower is None else lower[word]).tobytes())
    return out


def hashes(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inverse = _tables(len(total) - 1)
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
