"""Terms of texts counted where the texts are, in Arrow batches.

Code points are told apart by class, words get numbers, and pairs of words are pairs of numbers, so that a text's terms are counted without strings and
without a shuffle; strings are made of distinct terms only. The words are those of functions.text.tokens, the terms those of functions.text.terms for n up
to 2 in the common mode.
"""

from __future__ import annotations

import functools
import math
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.functions.batches import bounded
from lexigrove.functions.text import STOPWORDS, murmur3
from lexigrove.operators.vindex import _best

@functools.cache
def classes() -> np.ndarray:
    """For each code point 1 in words (letters, digits, marks), 2 for other visible characters, 0 for all else."""
    return np.array([{"L": 1, "N": 1, "M": 1, "Z": 0, "C": 0}.get(unicodedata.category(chr(i))[0], 2) for i in range(0x110000)], np.uint8)


def code_points(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """texts without nulls and bytes that are no UTF-8, the code points of all in turn, and where each text begins among them (and the last ends)."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    try:
        points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), "<u4")
    except UnicodeDecodeError:
        return code_points(pa.array([t.decode("utf-8", "replace").encode() for t in texts.to_pylist()], pa.large_binary()))
    before = np.zeros(len(raw) + 1, np.int64)  # characters before each byte
    np.cumsum((raw & 0xC0) != 0x80, out=before[1:])
    return texts, points, before[at - at[0]]


def _bytes_at(points: np.ndarray) -> np.ndarray:
    """Where each code point begins in UTF-8, and the last ends."""
    out = np.zeros(len(points) + 1, np.int64)
    np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000), out=out[1:])
    return out


class Words:
    """Words of a batch: the text of each (row), its number (word), whether it is no term (by number), and the newlines before it in its text (par)."""

    def __init__(self, texts: pa.Array, delimiter: str | None = None):
        texts, points, begins = code_points(texts)
        kind = classes()[points]
        first = np.zeros(len(points) + 1, bool)
        first[begins] = True
        first = first[:-1]
        other = np.ones(len(points), bool)
        other[1:] = kind[1:] != kind[:-1]
        parts = np.flatnonzero(first | other | (kind == 2))
        byte = _bytes_at(points)
        own = kind[parts] > 0
        at = np.r_[byte[parts], byte[-1]]
        raw = texts.buffers()[2]
        base = int(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset])
        listed = pa.LargeStringArray.from_buffers(len(parts), pa.py_buffer(at + base), raw if raw is not None else pa.py_buffer(b""))
        coded = pc.dictionary_encode(listed.filter(pa.array(own)))
        numbers: dict[str, int] = {}
        same = np.array([numbers.setdefault(w.lower(), len(numbers)) for w in coded.dictionary.to_pylist()], np.int64)
        self.lower = pa.array(list(numbers), pa.large_string())
        self.dropped = np.array([w in _STOP or len(w) == 1 and unicodedata.category(w)[0] == "P" for w in numbers], bool)
        self.shown = coded
        self.word = same[coded.indices.to_numpy()] if len(same) else np.zeros(0, np.int64)
        start = parts[own]
        self.row = np.searchsorted(begins, start, "right") - 1
        self.par = np.zeros(len(start), np.int64)
        if delimiter is not None:
            breaks = np.r_[0, np.cumsum(points == ord(delimiter))]
            self.par = breaks[start] - breaks[begins[self.row]]

    def terms(self, n: int, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the kept terms and their first and second words, the second -1 in terms of one word. keep: by number, whether a word may be in a term."""
        good = ~self.dropped if keep is None else ~self.dropped & keep
        good = good[self.word]
        one = np.flatnonzero(good)
        if n == 1:
            return one, self.word[one], np.full(len(one), -1)
        two = np.flatnonzero(good[:-1] & good[1:] & (self.row[1:] == self.row[:-1]))
        return np.r_[one, two], np.r_[self.word[one], self.word[two]], np.r_[np.full(len(one), -1), self.word[two + 1]]


_STOP = frozenset(STOPWORDS)


def _distinct(*keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct tuples of numbers (none negative but -1) in order, and how often each occurs."""
    sizes = [int(k.max(initial=-1)) + 2 for k in keys]
    if math.prod(sizes) >= 1 << 62:
        made, times = np.unique(np.stack(keys), axis=1, return_counts=True)
        return list(made), times
    whole = np.zeros(len(keys[0]), np.int64)
    for k, size in zip(keys, sizes):
        whole = whole * size + (k + 1)
    whole, times = np.unique(whole, return_counts=True)
    out = []
    for size in reversed(sizes):
        out.append(whole % size - 1)
        whole = whole // size
    return out[::-1], times


def _named(lower: pa.Array, first: np.ndarray, second: np.ndarray) -> pa.Array:
    """Terms as text; those of one word come first."""
    pairs = second >= 0
    made = [lower.take(pa.array(first[~pairs]))]
    if pairs.any():
        made.append(pc.binary_join_element_wise(lower.take(pa.array(first[pairs])), lower.take(pa.array(second[pairs])), pa.scalar(" ", pa.large_string())))
    return pa.concat_arrays(made).cast(pa.string())


def buckets(terms: pa.Array, size: int) -> np.ndarray:
    """Seed-0 MurmurHash3 of each term, modulo size; terms of one length are hashed together."""
    terms = terms.cast(pa.large_binary())
    at = np.frombuffer(terms.buffers()[1], np.int64)[terms.offset : terms.offset + len(terms) + 1]
    raw = np.frombuffer(terms.buffers()[2] or b"", np.uint8)
    length, out = np.diff(at), np.zeros(len(terms), np.int64)
    order = np.argsort(length, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
        if len(own):
            out[own] = (murmur3(raw[at[own][:, None] + np.arange(length[own[0]])]) % np.uint64(size)).astype(np.int64)
    return out


def by_text(
    docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 2, only: list[str] | None = None, delimiter: str | None = None, size: int | None = None,
) -> DataFrame:
    """key, term, tf for each text and term in it, without a shuffle; texts of equal keys are not added up.

    only: terms to count. delimiter: a sign that stands in no word; key, par_idx, term, tf, first then, where texts are cut at it: first is 1 once for each text
    and term, and rows of par_idx -1 are terms that only the uncut text has. size: key, bucket, tf by buckets of so many.
    """
    kind = docs.schema[key].dataType.simpleString()
    shared = None
    if delimiter is not None and (len(delimiter) != 1 or classes()[ord(delimiter)]):
        raise ValueError(f"not a sign between words: {delimiter!r}")
    if only is not None:
        words = sorted({w for t in only for w in t.split(" ")})
        place = {w: i for i, w in enumerate(words)}
        pairs = [[place[w] for w in t.split(" ")] for t in only]
        wanted = np.unique(np.array([p[0] * (len(words) + 1) + (p[1] + 1 if len(p) > 1 else 0) for p in pairs if len(p) <= n], np.int64))
        shared = docs.sparkSession.sparkContext.broadcast((place, wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from counted(batch)

    def counted(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        words = Words(batch.column(1), delimiter)
        keep = number = None
        if shared is not None:
            place, wanted = shared.value
            number = np.array([place.get(w, -1) for w in words.lower.to_pylist()], np.int64)
            keep = number >= 0
        at, first, second = words.terms(n, keep)
        if shared is not None:
            own = np.isin(number[first] * (len(place) + 1) + np.where(second >= 0, number[second] + 1, 0), wanted)
            at, first, second = at[own], first[own], second[own]
        pair = (second >= 0).astype(np.int64)
        row = words.row[at]
        more = {}
        if delimiter is not None:
            cut = (pair == 1) & (words.par[at] != words.par[np.minimum(at + pair, len(words.par) - 1)])
            par = np.where(cut, -1, words.par[at])
            (_, second, first, row, par), times = _distinct((second >= 0).astype(np.int64), second, first, row, par)
            # of a term's rows in a text the last is first: the others are of lower par_idx, -1 among them
            last = np.r_[(np.diff(second) != 0) | (np.diff(first) != 0) | (np.diff(row) != 0), np.ones(min(len(row), 1), bool)]
            good = last | (par >= 0)
            second, first, row, par, times, last = (x[good] for x in (second, first, row, par, times, last))
            more = {"par_idx": pa.array(par), "first": pa.array(last.astype(np.int64))}
        else:
            (_, second, first, row), times = _distinct(pair, second, first, row)
        begins = np.flatnonzero(np.r_[np.ones(min(len(row), 1), bool), (np.diff(second) != 0) | (np.diff(first) != 0)])
        term = _named(words.lower, first[begins], second[begins])
        kind_of = np.repeat(np.arange(len(begins)), np.diff(np.r_[begins, len(row)]))
        if size is not None:
            whole, place_of = np.unique(row * size + buckets(term, size)[kind_of], return_inverse=True)
            row, times = whole // size, np.bincount(place_of, times, len(whole)).astype(np.int64)
            made = {"bucket": pa.array(whole % size, pa.int64())}
        else:
            made = {"term": term.take(pa.array(kind_of))}
        made |= {key: batch.column(0).take(pa.array(row)), "tf": pa.array(times, pa.int64()), **more}
        yield pa.RecordBatch.from_pydict({c: made[c] for c in names})

    names = [key, "par_idx", "term", "tf", "first"] if delimiter is not None else [key, "term" if size is None else "bucket", "tf"]
    types = {"par_idx": "long", "term": "string", "bucket": "long", "tf": "long", "first": "long", key: kind}
    return bounded(docs).select(key, F.col(text).alias("text")).mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in names))


def words_between(docs: DataFrame, signs: str = " \t\r\n\u202f", key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, word, start and idx (the place among them) of the words between the signs of a text, without a shuffle."""
    kind = docs.schema[key].dataType.simpleString()
    apart = np.array(sorted(map(ord, signs)), np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts, points, begins = code_points(batch.column(1))
            own = ~np.isin(points, apart)
            edge = np.ones(len(points) + 1, bool)
            edge[1:-1] = own[1:] != own[:-1]
            edge[begins] = True
            parts = np.flatnonzero(edge)[:-1]
            byte = _bytes_at(points)
            base = int(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset])
            raw = texts.buffers()[2] or pa.py_buffer(b"")
            listed = pa.LargeStringArray.from_buffers(len(parts), pa.py_buffer(np.r_[byte[parts], byte[-1]] + base), raw)
            there = own[parts] if len(parts) else np.zeros(0, bool)
            start = parts[there]
            row = np.searchsorted(begins, start, "right") - 1
            first = np.searchsorted(row, row)
            yield pa.RecordBatch.from_pydict({
                key: batch.column(0).take(pa.array(row)), "word": listed.filter(pa.array(there)).cast(pa.string()),
                "start": pa.array(start - begins[row], pa.int64()), "idx": pa.array(np.arange(len(row)) - first, pa.int64()),
            })

    return bounded(docs).select(key, F.col(text).alias("text")).mapInArrow(run, f"`{key}` {kind}, word string, start long, idx long")


def gram_sizes(docs: DataFrame, ways: dict[str, str | Callable[[list[pa.Array]], np.ndarray | bool] | None], key: str = "doc_id", text: str = "text", n: int = 3) -> DataFrame:
    """key and, for each way, n_ and chars_ with its name: how many grams of 1 to n words of a text stay, and their characters. Texts without words have no row.

    ways: modes of functions.text.keeps_ngram, None to keep all grams, or a function of the gram's words (an array for each place) that says which stay.
    """
    kind = docs.schema[key].dataType.simpleString()
    if unknown := [w for w in ways.values() if not callable(w) and w not in ("any", "all", "ends", None)]:
        raise ValueError(f"unknown mode: {unknown[0]}")

    def kept(way, flags: list[np.ndarray], shown: list[pa.Array]) -> np.ndarray:
        if callable(way):
            return np.broadcast_to(np.asarray(way(shown), bool), len(shown[0]))
        if way is None:
            return np.ones(len(shown[0]), bool)
        own = [flags[0], flags[-1]] if way == "ends" else flags
        return ~np.logical_and.reduce(own) if way == "all" else ~np.logical_or.reduce(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            words = Words(batch.column(1))
            total = len(words.word)
            flag, size = words.dropped[words.word], np.asarray(pc.utf8_length(words.lower))[words.word] if total else np.zeros(0, np.int64)
            made = {f"{what}_{name}": np.zeros(batch.num_rows, np.int64) for name in ways for what in ("n", "chars")}
            for k in range(1, min(n, total) + 1):
                last = total - k + 1
                whole = words.row[:last] == words.row[k - 1 :]
                row = words.row[:last]
                chars = sum(size[j : j + last].astype(np.int64) for j in range(k)) + k - 1
                flags, shown = [flag[j : j + last] for j in range(k)], [words.shown.slice(j, last) for j in range(k)]
                for name, way in ways.items():
                    own = whole & kept(way, flags, shown)
                    made[f"n_{name}"] += np.bincount(row[own], minlength=batch.num_rows)
                    made[f"chars_{name}"] += np.bincount(row[own], chars[own], batch.num_rows).astype(np.int64)
            there = pa.array(np.bincount(words.row, minlength=batch.num_rows) > 0)
            yield pa.RecordBatch.from_pydict({key: batch.column(0).filter(there)} | {c: pa.array(x).filter(there) for c, x in made.items()})

    names = [f"{what}_{name}" for name in ways for what in ("n", "chars")]
    return bounded(docs).select(key, F.col(text).alias("text")).mapInArrow(run, ", ".join([f"`{key}` {kind}", *(f"`{c}` long" for c in names)]))


#: Sums of products that a task holds at once.
HELD = 1 << 22


def products(
    docs: DataFrame, asked: list[tuple[int, str, float]], qids: list, names: tuple[str, str, str, str], n: int = 2, per: float | None = None, digits: int = 6, k: int | None = None,
) -> DataFrame:
    """Question, text and score: the sum, over the terms they share, of the term's value in the question and ln(1 + tf), or tf / per, of the text.

    asked: place of the question in qids, term, value above 0. names: of the question's key and its type, of the key and the text in docs. All questions are scored
    with a text in the task that has it, so nothing is shuffled. k: of each question a task gives only its k best texts (of whole numbers as keys).
    """
    qid, qtype, key, text = names
    kind = docs.schema[key].dataType.simpleString()
    place = {w: i for i, w in enumerate(sorted({w for _, t, _ in asked for w in t.split(" ")}))}
    width = len(place) + 1
    coded = sorted((place[w[0]] * width + (place[w[1]] + 1 if len(w) > 1 else 0), q, v) for q, t, v in asked for w in [t.split(" ")])
    wanted, begins = np.unique(np.array([c for c, _, _ in coded], np.int64), return_index=True)
    times = np.diff(np.r_[begins, len(coded)])
    shared = docs.sparkSession.sparkContext.broadcast(
        (place, wanted, begins, times, np.array([q for _, q, _ in coded], np.int64), np.array([v for _, _, v in coded], np.float64), qids),
    )

    def scored(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        place, wanted, begins, times, question, value, qids = shared.value
        words = Words(batch.column(1))
        number = np.array([place.get(w, -1) for w in words.lower.to_pylist()], np.int64)
        at, first, second = words.terms(n, number >= 0)
        code = number[first] * width + np.where(second >= 0, number[second] + 1, 0)
        own = np.isin(code, wanted)
        (row, term), tf = _distinct(words.row[at[own]], np.searchsorted(wanted, code[own]))
        part = np.log1p(tf) if per is None else tf / per
        step = max(HELD // len(qids), 1)
        for low in range(0, batch.num_rows, step):
            some = slice(*np.searchsorted(row, [low, low + step]))
            each = times[term[some]]
            from_row = np.repeat(np.arange(len(each)), each)
            entry = begins[term[some]][from_row] + np.arange(len(from_row)) - (np.cumsum(each) - each)[from_row]
            total = np.bincount((row[some][from_row] - low) * len(qids) + question[entry], part[some][from_row] * value[entry])
            there = np.flatnonzero(total > 0)
            yield there // len(qids) + low, there % len(qids), np.round(total[there], digits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked_by = pa.array(shared.value[-1])
        least = np.full(len(asked_by), -np.inf)
        held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for batch in batches:
            whole = k is not None and batch.num_rows and not batch.column(0).null_count
            keys = batch.column(0).to_numpy() if whole else None
            for row, q, score in scored(batch) if batch.num_rows else ():
                if whole:
                    good = score >= least[q]
                    held = _best(*(np.r_[h, x] for h, x in zip(held, (q[good], keys[row[good]], score[good]))), k)
                    last = np.flatnonzero(np.bincount(held[0], minlength=len(least)) == k)
                    least[last] = held[2][np.searchsorted(held[0], last, "right") - 1]
                else:
                    yield pa.RecordBatch.from_pydict({qid: asked_by.take(pa.array(q)), key: batch.column(0).take(pa.array(row)), "score": pa.array(score)})
        if len(held[0]):
            yield pa.RecordBatch.from_pydict({qid: asked_by.take(pa.array(held[0])), key: pa.array(held[1]), "score": pa.array(held[2])})

    return bounded(docs).select(key, F.col(text).alias("text")).mapInArrow(run, f"`{qid}` {qtype}, `{key}` {kind}, score double")
