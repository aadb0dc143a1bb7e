"""Quality classes from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every text. Expectation-maximisation
over the counts of vote patterns (of all texts; there are at most 3 to the number of
labellers) estimates how often each labeller votes what on good and on bad texts, and so the
posterior of each pattern. Posteriors label a bounded sample of texts (about SAMPLE, by hash
of the text) on which a linear scorer over hashed features is trained; it scores every text.

Texts without words (null, empty) are voted bad by one labeller. Each row is scored alone;
repeated rows count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow, table
from .textwords import WHITE, mix, pieces, spans, word_hashes

BITS, SAMPLE, EPOCHS = 14, 20_000, 5
LABELLERS = ("symbols", "capitals", "variety", "echoes", "sentences", "word_length", "letters", "digits", "empty", "bare")
_KIND = np.zeros(256, np.uint8)  # 0 other, 1 lower, 2 upper, 3 digit, 4 white, 5 symbol, 6 end of a sentence
_KIND[97:123] = _KIND[128:256] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[[0x20, *range(9, 14)]] = 4
_KIND[list(b"%&$#*!|@^~<>{}\\=_+")] = 5
_KIND[list(b".?")] = 6


def measures(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ratios (text, measure), and (text, hashed feature) pairs of the words' shapes."""
    n = len(at) - 1
    kind = _KIND[data]
    upper = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[:-1] == 0xC3)) + 1 if len(data) else np.zeros(0, int)
    kind[upper] = 2
    text = np.repeat(np.arange(n), np.diff(at))
    by_kind = np.bincount(text * 7 + kind, minlength=7 * n).reshape(n, 7)[:, :7].astype(float)
    size = np.maximum(np.diff(at), 1)
    start, end, of = spans(data, at, WHITE)
    word = word_hashes(data, start, end) if len(start) else np.zeros(0, np.uint64)
    count = np.bincount(of, minlength=n)
    order = np.lexsort((word, of))
    w, o = word[order], of[order]
    new = np.r_[True, (w[1:] != w[:-1]) | (o[1:] != o[:-1])] if len(w) else np.zeros(0, bool)
    distinct = np.bincount(o[new], minlength=n)
    again = np.flatnonzero((word[1:] == word[:-1]) & (of[1:] == of[:-1]))
    echo = np.bincount(of[again], minlength=n)
    some = np.maximum(count, 1)
    bare = np.bincount(of[(end - start == 1) & np.isin(kind[start], (0, 5, 6))], minlength=n)
    letters = by_kind[:, 1] + by_kind[:, 2]
    ratios = np.stack(
        [
            by_kind[:, 5] / size, by_kind[:, 2] / np.maximum(letters, 1), distinct / some, echo / some, some / np.maximum(by_kind[:, 6], 0.5),
            (size - by_kind[:, 4]) / some, letters / np.maximum(size - by_kind[:, 4], 1), by_kind[:, 3] / size, count, bare / some,
        ],
        1,
    )
    if len(start):
        shape = (kind[start].astype(np.uint64) * np.uint64(8) + kind[end - 1]) * np.uint64(16) + np.minimum(end - start, 15).astype(np.uint64)
        feature = (mix(shape, 41) >> np.uint64(64 - BITS)).astype(np.int64)
    else:
        feature = np.zeros(0, np.int64)
    return ratios, of, feature


def votes(ratios: np.ndarray) -> np.ndarray:
    """1 good, 2 bad, 0 nothing, of each labeller."""
    symbols, capitals, variety, echoes, sentences, length, letters, digits, count, bare = ratios.T
    out = np.zeros((len(ratios), len(LABELLERS)), np.int64)

    def vote(i: int, good: np.ndarray, bad: np.ndarray) -> None:
        out[:, i] = np.where(bad, 2, np.where(good, 1, 0))

    words = count > 0
    vote(0, words & (symbols < 0.01), symbols > 0.05)
    vote(1, words & (capitals > 0.002) & (capitals < 0.15), capitals > 0.4)
    vote(2, (count >= 20) & (variety > 0.45), (count >= 12) & (variety < 0.35))
    vote(3, (count >= 8) & (echoes < 0.03), (count >= 8) & (echoes > 0.12))
    vote(4, words & (sentences > 2) & (sentences < 40), (count >= 40) & (sentences > 150))
    vote(5, words & (length > 2.5) & (length < 12), words & ((length > 25) | (length < 1.5)))
    vote(6, letters > 0.85, words & (letters < 0.6))
    vote(7, np.zeros(len(count), bool), digits > 0.3)
    vote(8, np.zeros(len(count), bool), ~words)
    vote(9, words & (bare < 0.03), (count >= 4) & (bare > 0.15))
    return out


def patterns(vote: np.ndarray) -> np.ndarray:
    return vote @ 3 ** np.arange(vote.shape[1])


def posteriors(pattern: np.ndarray, count: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Probability that texts of each pattern are good, by expectation-maximisation."""
    vote = pattern[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    good, bad = (vote == 1).sum(1), (vote == 2).sum(1)
    p = (good + 0.5) / (good + bad + 1.0)
    p = np.where(bad > 0, np.minimum(p, 0.4), p)
    for _ in range(rounds):
        share = np.clip((count * p).sum() / max(count.sum(), 1), 1e-4, 1 - 1e-4)
        log = np.log([[share], [1 - share]]) + np.zeros((2, len(pattern)))
        for c, weight in enumerate((count * p, count * (1 - p))):
            for i in range(vote.shape[1]):
                rate = np.bincount(vote[:, i], weight, 3) + 1.0
                log[c] += np.log(rate / rate.sum())[vote[:, i]]
        now = 1 / (1 + np.exp(np.clip(log[1] - log[0], -500, 500)))
        if np.abs(now - p).max(initial=0) < 1e-9:
            break
        p = now
    return p


def rows_of(ratios: np.ndarray, of: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value): shares of words by shape, and a feature for the size step of each ratio."""
    n = len(ratios)
    key, many = np.unique((of << BITS) | feature, return_counts=True)
    total = np.maximum(np.bincount(of, minlength=n), 1)
    text = key >> BITS
    step = np.floor(np.log2(np.maximum(ratios, 1e-4)) * 1.5).astype(np.int64) + 64
    stepped = (mix(
        (np.arange(ratios.shape[1], dtype=np.uint64)[None, :] * np.uint64(1024) + step.astype(np.uint64)).ravel(), 97,
    ) >> np.uint64(64 - BITS)).astype(np.int64)
    return (
        np.r_[text, np.repeat(np.arange(n), ratios.shape[1])],
        np.r_[key & ((1 << BITS) - 1), stepped],
        np.r_[np.sqrt(many / total[text]), np.full(len(stepped), 0.7)],
    )


@dataclass
class Scorer:
    bias: float
    weight: np.ndarray

    def score(self, of: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + np.bincount(of, self.weight[feature] * value, n), -30, 30)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, seed: int = 5) -> Scorer:
    scorer = Scorer(0.0, np.zeros(1 << BITS))
    if not len(rows):
        return scorer
    memory, memory_b = np.full(1 << BITS, 1e-3), 1e-3
    random = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for batch in np.array_split(random.permutation(len(rows)), max(1, len(rows) // 64)):
            feature = np.concatenate([rows[i][0] for i in batch])
            value = np.concatenate([rows[i][1] for i in batch])
            of = np.repeat(np.arange(len(batch)), [len(rows[i][0]) for i in batch])
            error = scorer.score(of, feature, value, len(batch)) - target[batch]
            g = np.bincount(feature, error[of] * value, 1 << BITS) / len(batch)
            memory += g * g
            scorer.weight -= 0.2 * (g + 1e-5 * scorer.weight) / np.sqrt(memory)
            memory_b += error.mean() ** 2
            scorer.bias -= 0.2 * error.mean() / np.sqrt(memory_b)
    return scorer


def _survey(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pattern counts of the task, and features of texts whose hash is below the limit."""
        total: dict[int, int] = {}
        for batch in batches:
            own, feature, value = [], [], []
            for _, data, at in pieces(batch.column(0)):
                ratios, of, shapes = measures(data, at)
                pattern = patterns(votes(ratios))
                for p, c in zip(*np.unique(pattern, return_counts=True)):
                    total[int(p)] = total.get(int(p), 0) + int(c)
                text, f, v = rows_of(ratios, of, shapes)
                raw = data.tobytes()
                for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                    if xxhash.xxh3_64_intdigest(raw[a:b]) <= limit:
                        mine = text == i
                        own.append(int(pattern[i]))
                        feature.append(f[mine].astype(np.int32).tobytes())
                        value.append(v[mine].astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array([1] * len(own), pa.int8()), pa.array(own, pa.int64()), pa.nulls(len(own), pa.int64()), pa.array(feature, pa.binary()), pa.array(value, pa.binary())],
                ["kind", "pattern", "n", "feature", "value"],
            )
        yield pa.RecordBatch.from_arrays(
            [pa.array([0] * len(total), pa.int8()), pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64()), pa.nulls(len(total), pa.binary()), pa.nulls(len(total), pa.binary())],
            ["kind", "pattern", "n", "feature", "value"],
        )

    return run


def fit(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> tuple[Scorer, np.ndarray]:
    """Scorer, and posterior of each pattern (NaN where it doesn't occur)."""
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    limit = min(2**64 - 1, int(2**64 * sample / max(1, docs.count())))
    seen = table(arrow(texts, _survey(limit), "kind tinyint, pattern long, n long, feature binary, value binary"), "survey")
    counted = seen.filter("kind = 0").groupBy("pattern").agg(F.sum("n").alias("n")).collect()  # as many as there are patterns
    pattern = np.array([r["pattern"] for r in counted], np.int64)
    posterior = np.full(3 ** len(LABELLERS), np.nan)
    posterior[pattern] = posteriors(pattern, np.array([r["n"] for r in counted], float))
    chosen = seen.filter("kind = 1").orderBy(F.xxhash64("feature", "value")).limit(2 * sample).select("pattern", "feature", "value").collect()
    rows = [(np.frombuffer(r["feature"], np.int32).astype(np.int64), np.frombuffer(r["value"], np.float32)) for r in chosen]
    return train(rows, posterior[[r["pattern"] for r in chosen]] if chosen else np.zeros(0)), posterior


def classify(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, score (probability of good), weak_label (posterior of the votes) and keep (score at or above the threshold)."""
    scorer, posterior = fit(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast((scorer, posterior))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, table_of = shared.value
        for batch in batches:
            score, weak = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for first, data, at in pieces(batch.column(1)):
                n = len(at) - 1
                ratios, of, shapes = measures(data, at)
                score[first : first + n] = own.score(*rows_of(ratios, of, shapes), n)
                weak[first : first + n] = table_of[patterns(votes(ratios))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array(weak), pa.array(score >= threshold)],
                ["id", "score", "weak_label", "keep"],
            )

    frame = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return arrow(frame, run, f"id {kind}, score double, weak_label double, keep boolean").withColumnRenamed("id", id_col)
