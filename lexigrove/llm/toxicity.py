"""Toxicity scores by a factorization machine over hashed terms.

Terms are words and the beginnings of longer words, in lower case, hashed to a fixed number of
features; a text's feature is 1 if it holds the term. The machine adds to the linear weights
the products of latent factors of all pairs of a text's features, so combinations count that
no additive weight expresses. It is trained in numpy by AdaGrad on a bounded sample of labelled
texts (SAMPLE of each class, by hash order); scoring covers every text.

Null and empty texts have no features and get the bias alone. Repeated labels of one id
count once, toxic winning; of texts of one labelled id the least in byte order is learned from. Without labels of both classes every score is the prior (0 with none).
Each row is scored alone: ties, repeated rows and further columns have no influence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow, give_back
from .textwords import LOWER, hashes, mix, pieces, spans, sums, word_hashes

BITS, FACTORS, SAMPLE, EPOCHS = 17, 4, 5000, 8
#: Weights start from the classes' odds where these differ by so many standard deviations, else from 0; shorter words than LONG bytes have no beginning of PREFIX bytes.
SURPRISE, PREFIX, LONG = 5.0, 6, 8
_SPLIT = np.ones(256, bool)
_SPLIT[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs, sorted."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = LOWER[data]
    accent = np.flatnonzero((low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[:-1] == 0xC3)) + 1
    low[accent] += 0x20  # capital letters of Latin-1
    start, end, of = spans(low, at, _SPLIT)
    total = sums(low, None)
    whole = mix(word_hashes(low, start, end, None), 11) >> np.uint64(64 - BITS)
    long = end - start >= LONG
    begun = mix(hashes(total, start[long], start[long] + PREFIX), 23) >> np.uint64(64 - BITS)
    key = np.r_[(of << BITS) | whole.astype(np.int64), (of[long] << BITS) | begun.astype(np.int64)]
    key.sort()
    key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
    return key >> BITS, key & ((1 << BITS) - 1)


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margin(self, of: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        out = self.bias + np.bincount(of, self.linear[feature], n)
        latent = self.factors[feature]
        for f in range(self.factors.shape[1]):
            out += 0.5 * np.bincount(of, latent[:, f], n) ** 2
        return out - 0.5 * np.bincount(of, (latent**2).sum(1), n)

    def score(self, of: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(of, feature, n), -30, 30)))


def train(rows: list[np.ndarray], labels: np.ndarray, prior: float, seed: int = 7) -> Machine:
    """AdaGrad on logistic loss; the classes weigh alike, the bias is set to the prior in the end."""
    size = 1 << BITS
    machine = Machine(0.0, np.zeros(size), np.zeros((size, FACTORS)))
    positive = int(labels.sum())
    if not positive or positive == len(labels):
        machine.bias = float(np.log(prior / (1 - prior))) if 0 < prior < 1 else (30.0 if prior else -30.0)
        return machine
    inside, outside = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for row, label in zip(rows, labels.tolist()):
        np.add.at(inside if label else outside, row, 1)
    there = inside + outside
    share = positive / len(labels)
    surprise = (inside - there * share) / np.sqrt(np.maximum(there, 1) * share * (1 - share))
    marked = np.abs(surprise) >= SURPRISE
    odds = np.log((inside + 0.5) / (positive + 1)) - np.log((outside + 0.5) / (len(labels) - positive + 1))
    machine.linear[marked] = odds[marked]
    random = np.random.default_rng(seed)
    met = there > 0
    machine.factors[met] = random.normal(0, 0.01, (int(met.sum()), FACTORS))
    weight = np.where(labels == 1, 0.5 * len(labels) / positive, 0.5 * len(labels) / (len(labels) - positive))
    seen_w, seen_v, seen_b = np.full(size, 1e-2), np.full((size, FACTORS), 1e-2), 1e-2
    for epoch in range(EPOCHS):
        for batch in np.array_split(random.permutation(len(rows)), max(1, len(rows) // 64)):
            feature = np.concatenate([rows[i] for i in batch])
            of = np.repeat(np.arange(len(batch)), [len(rows[i]) for i in batch])
            error = (machine.score(of, feature, len(batch)) - labels[batch]) * weight[batch]
            at, inverse = np.unique(feature, return_inverse=True)
            latent = machine.factors[feature]
            total = np.stack([np.bincount(of, latent[:, f], len(batch)) for f in range(FACTORS)], 1)
            grad = np.bincount(inverse, error[of], len(at)) / len(batch) + 2e-5 * machine.linear[at]
            seen_w[at] += grad**2
            machine.linear[at] -= 0.05 * grad / np.sqrt(seen_w[at])
            slope = error[of][:, None] * (total[of] - latent)
            grad = np.stack([np.bincount(inverse, slope[:, f], len(at)) for f in range(FACTORS)], 1) / len(batch) + 2e-4 * machine.factors[at]
            seen_v[at] += grad**2
            machine.factors[at] -= 0.05 * grad / np.sqrt(seen_v[at])
            step = error.mean()
            seen_b += step**2
            machine.bias -= 0.05 * step / np.sqrt(seen_b)
    if 0 < prior < 1:
        machine.bias += float(np.log(prior / (1 - prior)))
    return machine


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    sample: int = SAMPLE,
) -> Machine:
    """Machine from a sample of at most so many labelled texts of each class."""
    spark = docs.sparkSession
    marked = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
    marked = marked.filter("_id IS NOT NULL AND _y IN (0, 1)").groupBy("_id").agg(F.max("_y").alias("_y"))
    known = {r["_y"]: r["n"] for r in marked.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not known:
        return Machine(-30.0, np.zeros(1 << BITS), np.zeros((1 << BITS, FACTORS)))
    prior = known.get(1, 0) / sum(known.values())
    order = F.xxhash64(F.col("_id").cast("string"))
    parts = [marked.filter(F.col("_y") == y).orderBy(order, "_id").limit(sample) for y in sorted(known)]
    chosen = [(r["_id"], r["_y"]) for p in parts for r in p.collect()]
    chosen = spark.createDataFrame(chosen, marked.schema)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    texts = texts.join(F.broadcast(chosen), "_id").groupBy("_id", "_y").agg(F.min("_text").alias("_text")).select("_y", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, data, at in pieces(batch.column(1)):
                of, feature = features(data, at)
                cuts = np.searchsorted(of, np.arange(1, len(at) - 1))
                out += [x.astype(np.int32).tobytes() for x in np.split(feature, cuts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["y", "f"])

    rows = sorted((r["y"], bytes(r["f"])) for r in arrow(texts, run, "y int, f binary").collect())
    if not rows:
        return Machine(-30.0, np.zeros(1 << BITS), np.zeros((1 << BITS, FACTORS)))
    give_back()
    machine = train([np.frombuffer(f, np.int32) for _, f in rows], np.array([y for y, _ in rows]), prior)
    del rows
    give_back()
    return machine


def score(docs: DataFrame, machine: Machine, text_col: str = "text", keep: tuple[str, ...] = (), name: str = "score") -> DataFrame:
    """The columns in keep and the score of each text; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(Machine(machine.bias, machine.linear.astype(np.float32), machine.factors.astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for first, data, at in pieces(batch.column(0)):
                of, feature = features(data, at)
                out[first : first + len(at) - 1] = own.score(of, feature, len(at) - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out)], [*batch.schema.names[1:], "_score"])

    frame = docs.select(F.col(text_col).cast("string").alias("_text"), *keep)
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + ["_score double"])
    return arrow(frame, run, schema).withColumnRenamed("_score", name)


def held_out(id_column) -> object:
    """Rows that labels are never learned from."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Doc_id, held_out, score and predicted; learned from the labels of rows that are not held out."""
    machine = fit(docs, labels.filter(~held_out(F.col("doc_id"))))
    scored = score(docs, machine, keep=("doc_id",))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
