"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

A chunk of texts is cut into pre-tokens with vectorised class rules (the rules of the
public byte-level pre-tokeniser), equal pre-tokens are found by hash, and only pre-tokens
not met before in this worker are merged. The symbols of all of these lie in one flat
array; every round finds the lowest-ranked pair of each word by binary search over the
sorted pair keys and merges it everywhere in the word.

Null and empty texts encode to no ids. Equal rows give equal results; each row is
encoded alone, so ties, repeated rows and further columns have no influence.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow

SPACE, LETTER, NUMBER, OTHER, CUT = range(5)
_NONE = np.int64(1 << 40)
_LONG_CODE = 2**64 - 1 - (1 << 32)
#: Longer pre-tokens are not told apart by their hash.
LONG_WORD = 32
#: Code points that one numpy pass works on, and distinct words that a worker remembers.
CHUNK_CHARS, REMEMBERED_WORDS = 1 << 20, 400_000


@functools.lru_cache(1)
def _classes() -> np.ndarray:
    """Class of each code point: white space, letter, number or other."""
    kinds = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for cp in range(sys.maxunicode + 1):
        first = unicodedata.category(chr(cp))[0]
        if first == "L":
            kinds[cp] = LETTER
        elif first == "N":
            kinds[cp] = NUMBER
    kinds[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return kinds


def _powers(n: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class ByteBPE:
    """Encoder of one vocabulary file of the tokenizers library (byte-level BPE, no normaliser)."""

    def __init__(self, path: str, strings: bool = False):
        self.strings = strings  # keep each word's ids as text and its decoded bytes, too
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_char = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        char_byte = {c: b for b, c in byte_char.items()}
        self.byte_id = np.array([vocab[byte_char[b]] for b in range(256)], np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes = {i: bytes(char_byte[c] for c in t) for t, i in vocab.items()}
        self.token_bytes |= {i: t.encode() for t, i in self.special.items()}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([(vocab[a] << 20) | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.power = _powers(CHUNK_CHARS + 1)
        self.unpower = _powers(CHUNK_CHARS + 1, pow(0x9E3779B97F4A7C15, -1, 1 << 64))
        self.forget()

    def forget(self) -> None:
        """Drop the remembered words; the vocabulary stays."""
        self.index: dict[int, int] = {}
        self.long: dict[str, int] = {}
        self.long_size = 0
        self.lengths = np.zeros(1 << 12, np.int64)
        self.offsets = np.zeros(1 << 12, np.int64)
        self.store = np.zeros(1 << 14, np.uint32)
        self.used = self.words = 0
        self.decimal: list[bytes] = []
        self.raw: list[bytes] = []

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair by binary search over the sorted pair keys."""
        key = (left << 20) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and the number of ids of each."""
        sizes = np.array([len(w) for w in words], np.int64)
        symbol = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        done_symbols, done_words = [], []
        rank = np.full(len(symbol), _NONE)
        if len(symbol) > 1:
            rank[:-1] = np.where(word[1:] == word[:-1], self._ranks(symbol[:-1], symbol[1:]), _NONE)
        while len(symbol):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, first)
            best = np.repeat(best, np.diff(np.r_[first, len(symbol)]))
            over = best == _NONE
            if over.any():
                done_symbols.append(symbol[over])
                done_words.append(word[over])
                left = ~over
                symbol, word, rank, best = symbol[left], word[left], rank[left], best[left]
                if not len(symbol):
                    break
            at = np.flatnonzero(rank == best)
            joined = np.r_[False, at[1:] == at[:-1] + 1]
            if joined.any():  # a run of one symbol: every second pair from its start
                start = np.maximum.accumulate(np.where(joined, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - start) % 2 == 0]
            symbol[at] = self.merged[rank[at]]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            moved = at - np.arange(len(at))
            symbol, word, rank = symbol[keep], word[keep], rank[keep]
            touched = np.stack([np.maximum(moved - 1, 0), moved], 1).ravel()
            touched = touched[np.r_[True, touched[1:] != touched[:-1]]]
            right = np.minimum(touched + 1, len(symbol) - 1)
            rank[touched] = np.where((right > touched) & (word[touched] == word[right]), self._ranks(symbol[touched], symbol[right]), _NONE)
        symbols, of = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_symbols, done_words))
        order = np.argsort(of, kind="stable")
        return symbols[order], np.bincount(of, minlength=len(words))

    def _learn(self, words: list[str]) -> None:
        """Encode words and remember them after those known."""
        plain = [w.encode("utf-8", "surrogatepass") for w in words]
        ids, sizes = self.merge(plain)
        self._keep(ids, sizes)

    def _keep(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        n, k = len(sizes), len(ids)
        while self.words + n > len(self.lengths):
            self.lengths = np.r_[self.lengths, np.zeros_like(self.lengths)]
            self.offsets = np.r_[self.offsets, np.zeros_like(self.offsets)]
        while self.used + k > len(self.store):
            self.store = np.r_[self.store, np.zeros_like(self.store)]
        self.lengths[self.words : self.words + n] = sizes
        self.offsets[self.words : self.words + n] = self.used + np.cumsum(sizes) - sizes
        self.store[self.used : self.used + k] = ids
        self.words += n
        self.used += k
        if self.strings:
            at = 0
            flat, table = ids.tolist(), self.token_bytes
            for size in sizes.tolist():
                own = flat[at : at + size]
                at += size
                self.decimal.append(",".join(map(str, own)).encode())
                self.raw.append(b"".join([table[i] for i in own]))

    def words_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the known words that the texts consist of, in one array, and where each text's begin (n + 1 places)."""
        if self.words > REMEMBERED_WORDS or self.long_size > CHUNK_CHARS:
            self.forget()
        parts: list[str] = []
        owner: list[int] = []
        special: list[tuple[int, int]] = []  # part that is a special token, its id
        for i, text in enumerate(texts):
            pieces = [text]
            for content in self.special:
                if content in text:
                    pieces = [y for x in pieces for y in ([x] if x in self.special else _cut_at(x, content))]
            for piece in pieces:
                if piece in self.special:
                    special.append((len(parts), self.special[piece]))
                parts.append(piece)
                owner.append(i)
        whole = "\n".join(parts) + "\n"
        cps = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
        ends = np.cumsum(np.array([len(p) + 1 for p in parts], np.int64))
        kind = _classes()[cps]
        kind[ends - 1] = CUT
        start = np.empty(len(cps), bool)
        start[0] = True
        np.not_equal(kind[1:], kind[:-1], out=start[1:])
        start[ends - 1] = True
        nxt = np.r_[kind[1:], np.uint8(CUT)]
        last = np.flatnonzero((kind == SPACE) & (nxt != SPACE) & (nxt != CUT))
        start[last] = True
        start[last[cps[last] == 0x20] + 1] = False
        quote = np.flatnonzero((cps == 0x27) & start & (nxt == LETTER))
        if len(quote):  # the short endings of English
            one, two = cps[quote + 1], cps[np.minimum(quote + 2, len(cps) - 1)]
            single = np.isin(one, [ord(c) for c in "stmd"])
            double = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            start[quote[single | double] + 1] = False
            start[quote[single] + 2] = True
            start[quote[double] + 3] = True
        marks: list[int] = []
        for part, _ in special:
            begin = int(ends[part]) - 1 - len(parts[part])
            start[begin : ends[part] - 1] = False
            start[begin] = True
            marks.append(begin)
        begin = np.flatnonzero(start)
        is_cut = kind[begin] == CUT
        stop = np.r_[begin[1:], len(cps)]
        begin, stop = begin[~is_cut], stop[~is_cut]
        power, unpower = self.power, self.unpower
        if len(cps) > CHUNK_CHARS:
            power, unpower = _powers(len(cps) + 1), _powers(len(cps) + 1, pow(0x9E3779B97F4A7C15, -1, 1 << 64))
        total = np.empty(len(cps) + 1, np.uint64)
        total[0] = 0
        np.cumsum((cps.astype(np.uint64) + np.uint64(0x1D872B41)) * power[: len(cps)], out=total[1:])
        code = (total[stop] - total[begin]) * unpower[begin]
        code ^= code >> np.uint64(31)
        for i in np.flatnonzero(stop - begin > LONG_WORD).tolist():  # told apart by themselves, as the sums don't do it for all
            word = whole[begin[i] : stop[i]]
            if word not in self.long:
                self.long[word] = len(self.long)
                self.long_size += len(word)
            code[i] = _LONG_CODE - self.long[word]
        if marks:  # special tokens never share a hash with ordinary words
            code[np.searchsorted(begin, marks)] = [2**64 - 1 - i for _, i in special]
        which, distinct = pd.factorize(code)
        known = self.index
        number = np.array(list(map(known.get, distinct.tolist(), itertools.repeat(-1))), np.int64)
        new = np.flatnonzero(number < 0)
        if len(new):
            where = np.empty(len(distinct), np.int64)
            where[which[::-1]] = np.arange(len(which))[::-1]
            number[new] = self.words + np.arange(len(new))
            known.update(zip(distinct[new].tolist(), number[new].tolist()))
            spans = where[new]
            words = [whole[a:b] for a, b in zip(begin[spans].tolist(), stop[spans].tolist())]
            if marks:
                ids = dict(zip(marks, [i for _, i in special]))
                for w, a in zip(words, begin[spans].tolist()):
                    if a in ids:
                        self._keep(np.array([ids[a]]), np.array([1]))
                    else:
                        self._learn([w])
            else:
                self._learn(words)
        of_part = np.searchsorted(begin, np.r_[0, ends])
        parts_of = np.searchsorted(np.array(owner, np.int64), np.arange(len(texts) + 1))
        return number[which], of_part[parts_of]

    def ids(self, words: np.ndarray) -> np.ndarray:
        """Ids of words by their numbers, in one array."""
        sizes = self.lengths[words]
        shift = self.offsets[words] - (np.cumsum(sizes) - sizes)
        return self.store[np.arange(int(sizes.sum())) + np.repeat(shift, sizes)]

    def encode(self, text: str | None) -> list[int]:
        words, _ = self.words_of([text or ""])
        return self.ids(words).tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.token_bytes[i] for i in ids]).decode("utf-8", "replace")


def _cut_at(text: str, mark: str) -> list[str]:
    out: list[str] = []
    for i, x in enumerate(text.split(mark)):
        out += [mark, x] if i else [x]
    return out


@functools.lru_cache(2)
def encoder(path: str, strings: bool = False) -> ByteBPE:
    """One encoder for each worker, vocabulary file and use."""
    return ByteBPE(path, strings)


def chunks(column: pa.Array, most: int = CHUNK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """First row and texts (null: empty) of chunks with at most so many characters, or of one text."""
    first, held, size = 0, [], 0
    for i in range(len(column)):
        text = column[i].as_py() or ""
        if held and size + len(text) + 1 > most:
            yield first, held
            first, held, size = i, [], 0
        held.append(text)
        size += len(text) + 1
    if held:
        yield first, held


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode each text and decode its ids again.

    Returns id, n_tokens, ids_sha256, decoded_sha256 and, with keep_ids, ids and decoded.
    No shuffle; memory is bounded by a chunk of texts and the remembered words.
    """
    more = ", ids array<int>, decoded string" if keep_ids else ""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, strings=True)
        for batch in batches:
            count, told, back, all_ids, texts_out = [], [], [], [], []
            for _, texts in chunks(batch.column(1)):
                words, at = bpe.words_of(texts)
                sizes = np.r_[0, np.cumsum(bpe.lengths[words])]
                decimal, raw, flat = bpe.decimal, bpe.raw, words.tolist()
                for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                    own = flat[a:b]
                    count.append(int(sizes[b] - sizes[a]))
                    told.append(hashlib.sha256(b",".join([decimal[w] for w in own])).hexdigest())
                    decoded = b"".join([raw[w] for w in own]).decode("utf-8", "replace")
                    back.append(hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
                    if keep_ids:
                        all_ids.append(bpe.ids(words[a:b]).astype(np.int32))
                        texts_out.append(decoded)
            columns = [batch.column(0), pa.array(count, pa.int64()), pa.array(told, pa.string()), pa.array(back, pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns += [pa.array([x.tolist() for x in all_ids], pa.list_(pa.int32())), pa.array(texts_out, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return arrow(out, run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}").withColumnRenamed("id", id_col)
