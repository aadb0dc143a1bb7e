"""Masked pseudo-likelihood of texts under a bidirectional window network, trained in numpy.

Words fall into 2**BIN_BITS hashed bins. The WORDS commonest bins are units of their own; the others fall into
RARE units by their counts, within which a bin has its share of the counts. Common units are clustered into
classes by the units beside them (k-means over their neighbours' shares); each rare unit is a class.

The network sees the REACH units on either side of a masked word (a border unit beyond the text), each by a learned
vector weighed by place, and predicts its class. The unit within the class follows from counts of units after
the left neighbour's class and before the right one's, smoothed by the unit's share of its class. So every factor but a rare
word's share of its unit depends on the words on both sides, and the probabilities of all bins sum to 1. A text's
score is the sum of the log-probabilities of all its words, each given both sides.

Texts are cut into words once and dealt to shards by a hash of the row; the number of shards follows from the bytes of all
texts. Every shard trains from common weights on each place of each of its texts, in the order of the hashes; the weights are
averaged by places, vectors by how often their unit was seen. Counts and weights are summed in segments by
task, then over tasks, so results don't depend on the partitions (but for the rounding of sums), and what is gathered grows with the input.

Beside the network's scores stands what the other texts tell: over all places, the mean log-probability of the word by its
count between the same neighbours, without the text's own places. This is a deleted estimate from counts of every place of all
texts, which grow with the input and stay distributed; texts that occur twice stand out. All places of two neighbours are counted in one
task, but those of frequent neighbours, which are dealt out by the word between them; words that are frequent there are counted before.

Null and empty texts have no words and score 0; they are as likely there as a uniform choice. Each row is scored alone; repeated rows
count as often as they occur in the counts and in training. Ids may repeat or be null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow, drop_table, shuffles_removed, table, width
from .textwords import LOWER, WHITE, mix, pieces, spans, word_hashes

BIN_BITS, WORDS, RARE, CLUSTERS, WIDTH, REACH = 20, 1 << 14, 16, 48, 32, 2
UNITS, CLASSES, BORDER = WORDS + RARE, CLUSTERS + RARE, WORDS + RARE
#: Bytes of text of a shard; places of a step; size of a step; weight of a unit's share against counts beside a class.
SHARD_BYTES, BATCH, STEP, SMOOTH = 4 << 20, 2048, 0.1, 20.0
#: Weight of a uniform choice of bins between two neighbours; binary places of log-probabilities there.
UNIFORM, FRACTION = 1.0, 30
#: Places that are counted together, about, and that are dealt out at once; cells among which frequent contexts are looked for.
PART_PLACES, GROUP, CELL_BITS = 1 << 21, 1 << 21, 16
#: Neighbours that k-means tells apart on either side, its rounds; numbers of a segment.
NEAR, MEANS_ROUNDS, SEGMENT = 64, 15, 1 << 14


@dataclass
class Network:
    """unit and log_share: of each bin. classes: of each unit and the border. Then weights, and counts beside classes."""

    unit: np.ndarray
    log_share: np.ndarray
    classes: np.ndarray
    share: np.ndarray
    vectors: np.ndarray
    places: np.ndarray
    hidden: np.ndarray
    output: np.ndarray
    bias: np.ndarray
    beside: list[np.ndarray] = field(default_factory=list)
    totals: list[np.ndarray] = field(default_factory=list)

    def log_class(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vectors of the context, hidden layer and log-probabilities of all classes for rows of context units."""
        x, h, z = self.logits(context)
        return x, h, z - np.log(np.exp(z).sum(1, keepdims=True))

    def logits(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = self.vectors[context]
        h = np.tanh(np.einsum("bkw,kw->bw", x, self.places) + self.hidden)
        z = h @ self.output + self.bias
        return x, h, z - z.max(1, keepdims=True)

    def log_unit(self, unit: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Log-probability of each unit within its class, given the classes on both sides: the mean of both."""
        own = self.classes[unit]
        out = np.zeros(len(unit))
        for counts, total, side in zip(self.beside, self.totals, (REACH - 1, REACH)):
            by = self.classes[context[:, side]]
            out += 0.5 * (counts[by, unit] + SMOOTH * self.share[unit]) / (total[by, own] + SMOOTH)
        return np.log(out)


def bins(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin of each word and its text."""
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    start, end, of = spans(LOWER[data], at, WHITE)
    return (word_hashes(data, start, end) >> np.uint64(64 - BIN_BITS)).astype(np.int32), of


def contexts(unit: np.ndarray, of: np.ndarray, border: int = BORDER) -> np.ndarray:
    """Units (or bins) around each place; border beyond the text. of: the texts of the places, sorted."""
    out = np.full((len(unit), 2 * REACH), border, np.int32)
    for k, shift in enumerate([*range(-REACH, 0), *range(1, REACH + 1)]):
        n = len(unit) - abs(shift)
        if n > 0:
            here, there = (slice(-shift, None), slice(0, n)) if shift < 0 else (slice(0, n), slice(shift, None))
            out[here, k] = np.where(of[here] == of[there], unit[there], border)
    return out


def units_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit and log share of each bin, and mass of each unit: bins by falling count, those after WORDS in RARE units of about equal mass."""
    mass = counts + 0.5
    order = np.argsort(-mass, kind="stable")
    unit = np.empty(len(counts), np.int32)
    unit[order[:WORDS]] = np.arange(min(WORDS, len(counts)))
    rest = order[WORDS:]
    running = np.cumsum(mass[rest])
    unit[rest] = WORDS + np.minimum((running - mass[rest] / 2) / running[-1] * RARE, RARE - 1).astype(np.int32)
    total = np.bincount(unit, mass, UNITS)
    return unit, np.log(mass / total[unit]).astype(np.float32), total


def near_features(unit: np.ndarray) -> np.ndarray:
    """Which of NEAR neighbours a unit counts as: the commonest by themselves, the others hashed."""
    own = NEAR * 3 // 4
    other = own + (mix(unit.astype(np.uint64), 3) % np.uint64(NEAR - own)).astype(np.int64)
    return np.where(unit < own, unit, other)


def clustered(beside: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """Classes of all units and of the border: common units by weighted k-means over roots of their neighbours' shares, from the commonest units on."""
    x = np.sqrt(beside / np.maximum(beside.sum(1, keepdims=True), 1))
    centre = x[:CLUSTERS].copy()
    of = np.zeros(WORDS, np.int64)
    for _ in range(MEANS_ROUNDS):
        of = ((centre * centre).sum(1)[None, :] - 2 * x @ centre.T).argmin(1)
        total = np.bincount(of, mass[:WORDS], CLUSTERS)
        for k in np.flatnonzero(total):
            mine = of == k
            centre[k] = (x[mine] * mass[:WORDS][mine, None]).sum(0) / total[k]
    return np.r_[of, np.arange(CLUSTERS, CLASSES), CLASSES].astype(np.int32)


def new_network(unit: np.ndarray, log_share: np.ndarray, mass: np.ndarray, classes: np.ndarray, seed: int = 3) -> Network:
    total = np.bincount(classes[:UNITS], mass, CLASSES)
    r = np.random.default_rng(seed)
    with np.errstate(divide="ignore", invalid="ignore"):
        share = np.where(total[classes[:UNITS]] > 0, mass / total[classes[:UNITS]], 0).astype(np.float32)
        prior = np.log(np.maximum(total, 0.5) / mass.sum())
    draw = lambda *shape: r.normal(0, 0.1, shape).astype(np.float32)
    return Network(
        unit, log_share, classes, share, draw(UNITS + 1, WIDTH), np.ones((2 * REACH, WIDTH), np.float32),
        np.zeros(WIDTH, np.float32), draw(WIDTH, CLASSES), prior.astype(np.float32),
    )


class Trainer:
    """Steps of AdaGrad from given weights; vectors have one memory a unit."""

    def __init__(self, net: Network):
        self.net = net
        self.vectors = net.vectors.copy()
        self.dense = [x.copy() for x in (net.places, net.hidden, net.output, net.bias)]
        self.memory = [np.full_like(x, 1e-3) for x in self.dense]
        self.vector_memory = np.full(len(self.vectors), 1e-3, np.float32)
        self.seen = np.zeros(len(self.vectors), np.int64)
        self.places = 0

    def gradients(self, context: np.ndarray, target: np.ndarray) -> tuple:
        """Units of the context with the gradients of their vectors, and those of the other weights."""
        now = Network(*([None] * 4), self.vectors, *self.dense)
        x, h, z = now.logits(context)
        dz = np.exp(z)
        dz /= dz.sum(1, keepdims=True)
        dz[np.arange(len(target)), target] -= 1
        dz /= len(target)
        dh = (dz @ self.dense[2].T) * (1 - h * h)
        return (dh[:, None, :] * self.dense[0]).reshape(-1, WIDTH), (np.einsum("bkw,bw->kw", x, dh), dh.sum(0), h.T @ dz, dz.sum(0))

    def step(self, context: np.ndarray, target: np.ndarray) -> None:
        each, others = self.gradients(context, target)
        for x, g, m in zip(self.dense, others, self.memory):
            m += g * g
            x -= STEP * g / np.sqrt(m + 1e-6)
        unit = context.ravel()
        order = np.argsort(unit.astype(np.int16), kind="stable")  # sorted by digits
        unit = unit[order]
        first = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
        unit, g = unit[first], np.add.reduceat(each[order], first, 0)
        self.seen[unit] += np.diff(np.r_[first, len(order)])
        self.vector_memory[unit] += (g * g).mean(1)
        self.vectors[unit] -= STEP * g / np.sqrt(self.vector_memory[unit] + 1e-6)[:, None]
        self.places += len(target)


def _words(shards: int, id_type: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes] = []
            for _, data, at in pieces(batch.column(2)):
                word, of = bins(data, at)
                bounds = np.searchsorted(of, np.arange(len(at))).tolist()
                out += [word[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
            h = batch.column(1).to_numpy()
            shard = pa.array(mix(h.view(np.uint64), 9) % np.uint64(shards)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), shard, batch.column(1), pa.array(out, pa.binary())], ["id", "shard", "h", "words"])

    return run


def _texts(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Bins of all words of a batch, and the row of each."""
    column = batch.column(i)
    sizes = np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]) // 4
    data = np.frombuffer(b"".join(column.to_pylist()), np.int32)
    return data, np.repeat(np.arange(len(column)), sizes)


def _segments(name: int, sums: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(name, segment, bytes) of what isn't 0."""
    flat = np.ascontiguousarray(sums, np.float64).ravel()
    for a in range(0, len(flat), SEGMENT):
        if flat[a : a + SEGMENT].any():
            yield name, a // SEGMENT, flat[a : a + SEGMENT].tobytes()


def _parts(rows: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 32):
        name, segment, part = zip(*rows[i : i + 32])
        yield pa.RecordBatch.from_arrays(
            [pa.array(name, pa.int32()), pa.array(segment, pa.int32()), pa.array(part, pa.binary())],
            ["name", "segment", "sums"],
        )


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the rows of each segment, which come together."""
    last, total = None, np.zeros(0)
    for batch in batches:
        for name, segment, part in zip(*(c.to_pylist() for c in batch.columns)):
            now = np.frombuffer(part, np.float64)
            if (name, segment) != last:
                if last is not None:
                    yield from _parts([(*last, total.tobytes())])
                last, total = (name, segment), np.zeros(len(now))
            total = total + now
    if last is not None:
        yield from _parts([(*last, total.tobytes())])


_SUMS = "name int, segment int, sums binary"


def _gathered(frame: DataFrame, shapes: list[tuple[int, ...]]) -> list[np.ndarray]:
    """Sums over all tasks. Their size is that of the model, whatever the input."""
    spread = frame.repartition(width(frame.sparkSession), "name", "segment").sortWithinPartitions("name", "segment")
    out = [np.zeros(int(np.prod(s))) for s in shapes]
    with shuffles_removed(frame.sparkSession):
        rows = arrow(spread, _added, _SUMS).collect()
    for r in rows:
        part = np.frombuffer(r["sums"], np.float64)
        out[r["name"]][r["segment"] * SEGMENT : r["segment"] * SEGMENT + len(part)] = part
    return [x.reshape(s) for x, s in zip(out, shapes)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << BIN_BITS, np.int64)
    for batch in batches:
        counts += np.bincount(_texts(batch, 0)[0], minlength=1 << BIN_BITS)
    yield from _parts(list(_segments(0, counts)))


def _neighbours(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit_of = shared.value
        near = np.r_[near_features(np.arange(UNITS)), 0]
        counts = np.zeros(WORDS * 2 * NEAR, np.int64)
        for batch in batches:
            word, of = _texts(batch, 0)
            unit = unit_of[word]
            context = contexts(unit, of)
            common = unit < WORDS
            for side, k in enumerate((REACH - 1, REACH)):
                mine = common & (context[:, k] != BORDER)
                counts += np.bincount((unit[mine].astype(np.int64) * 2 + side) * NEAR + near[context[mine, k]], minlength=len(counts))
        yield from _parts(list(_segments(0, counts)))

    return run


def _learn(shared):
    """Sums of weights by places, of vectors by the times their units were seen, and counts beside classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        vectors, seen = np.zeros((UNITS + 1, WIDTH)), np.zeros(UNITS + 1)
        dense = [np.zeros(x.shape) for x in (net.places, net.hidden, net.output, net.bias)]
        beside = [np.zeros((CLASSES + 1) * UNITS, np.int64) for _ in range(2)]
        places = 0
        trainer, last = Trainer(net), None
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def closed() -> None:
            """Add what the shard has learned."""
            nonlocal trainer, held, places
            if held:
                trainer.step(*(np.concatenate(x) for x in zip(*held)))
            if trainer.places:
                vectors[:] += trainer.vectors * trainer.seen[:, None]
                seen[:] += trainer.seen
                for total, x in zip(dense, trainer.dense):
                    total += x.astype(np.float64) * trainer.places
                places += trainer.places
            trainer, held = Trainer(net), []

        for batch in batches:
            word, of = _texts(batch, 1)
            unit = net.unit[word]
            context = contexts(unit, of)
            for counts, k in zip(beside, (REACH - 1, REACH)):
                counts += np.bincount(net.classes[context[:, k]].astype(np.int64) * UNITS + unit, minlength=len(counts))
            shard = batch.column(0).to_numpy()
            edges = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True])
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if shard[a] != last:
                    closed()
                    last = shard[a]
                low, high = np.searchsorted(of, (a, b))
                target = net.classes[unit[low:high]]
                size = sum(len(t) for _, t in held)
                at = 0
                while size + len(target) - at >= BATCH:  # steps don't depend on where batches end
                    take = BATCH - size
                    held.append((context[low + at : low + at + take], target[at : at + take]))
                    trainer.step(*(np.concatenate(x) for x in zip(*held)))
                    held, size, at = [], 0, at + take
                if at < len(target):
                    held.append((context[low + at : high], target[at:]))
        closed()
        if places:
            for i, x in enumerate([vectors, seen, *dense, np.array([float(places)]), *beside]):
                yield from _parts(list(_segments(i, x)))

    return run


def dealt(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, shard, h and words (bins) of each text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), text).alias("h"), text.alias("text"))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    shards = int(size // SHARD_BYTES) + 1
    kind = docs.schema[id_col].dataType.simpleString()
    cut = arrow(rows, _words(shards, kind), f"id {kind}, shard long, h long, words binary")
    return table(cut, "words")


def fit(texts: DataFrame) -> Network:
    """The network of all texts that dealt() has cut into words."""
    spark = texts.sparkSession
    words = texts.select("words")
    (counts,) = _gathered(arrow(words, _count, _SUMS), [(1 << BIN_BITS,)])
    unit, log_share, mass = units_of(counts)
    (near,) = _gathered(arrow(words, _neighbours(spark.sparkContext.broadcast(unit)), _SUMS), [(WORDS, 2 * NEAR)])
    net = new_network(unit, log_share, mass, clustered(near, mass))
    # a shard's rows lie in one partition, in order
    parts = width(spark)
    ordered = texts.select("shard", "h", "words").repartitionById(
        parts, (F.col("shard") % parts).cast("int"),
    ).sortWithinPartitions("shard", "h").select("shard", "words")
    shapes = [
        (UNITS + 1, WIDTH), (UNITS + 1,), net.places.shape, net.hidden.shape, net.output.shape, net.bias.shape, (1,),
        *[(CLASSES + 1, UNITS)] * 2,
    ]
    vectors, seen, *dense, places, left, right = _gathered(arrow(ordered, _learn(spark.sparkContext.broadcast(net)), _SUMS), shapes)
    if places[0]:
        known = seen > 0
        net.vectors[known] = (vectors[known] / seen[known, None]).astype(np.float32)
        net.places, net.hidden, net.output, net.bias = ((x / places[0]).astype(np.float32) for x in dense)
    own = net.classes[:UNITS]
    net.beside = [x.astype(np.float32) for x in (left, right)]
    net.totals = [np.stack([np.bincount(own, row, CLASSES) for row in x]).astype(np.float32) for x in (left, right)]
    return net


def log_likelihoods(net: Network, word: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Log-probability of each word given both sides."""
    out = np.empty(len(word))
    unit = net.unit[word]
    context = contexts(unit, of)
    for i in range(0, len(word), BATCH):
        part = slice(i, i + BATCH)
        logp = net.log_class(context[part])[2]
        own = net.classes[unit[part]]
        out[part] = logp[np.arange(len(own)), own] + net.log_unit(unit[part], context[part]) + net.log_share[word[part]]
    return out


def score(texts: DataFrame, net: Network, id_col: str = "doc_id") -> DataFrame:
    """Id, h, n_tokens, pseudo_log_likelihood (a sum) and mean_log_likelihood (0 without words) of texts that dealt() has cut into words."""
    shared = texts.sparkSession.sparkContext.broadcast(net)
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            word, of = _texts(batch, 2)
            n = np.bincount(of, minlength=batch.num_rows)
            total = np.bincount(of, log_likelihoods(own, word, of), batch.num_rows).astype(np.float64)  # without words it counts in integers
            columns = [batch.column(0), batch.column(1), pa.array(n), pa.array(total), pa.array(total / np.maximum(n, 1))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "h", "n_tokens", "pseudo_log_likelihood", "mean_log_likelihood"])

    out = arrow(texts.select("id", "h", "words"), run, f"id {kind}, h long, n_tokens long, pseudo_log_likelihood double, mean_log_likelihood double")
    return out.withColumnRenamed("id", id_col)


def _keys(word: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Both neighbours' bins and the word's as one number for each place: no two triples share one. of: the texts of the places, sorted."""
    left, right = (np.full(len(word), 1 << BIN_BITS, np.uint64) for _ in range(2))
    same = np.flatnonzero(of[1:] == of[:-1])
    left[same + 1], right[same] = word[same], word[same + 1]
    return ((left * np.uint64((1 << BIN_BITS) + 1) + right) << np.uint64(BIN_BITS)) | word.astype(np.uint64)


_WORD_BITS = np.uint64(BIN_BITS)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """h of each text, key and text of each place, for about GROUP places at once."""
    held: list[tuple] = []

    def closed() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        first = np.cumsum([0, *(len(h) for h, _, _ in held)])
        return np.concatenate([h for h, _, _ in held]), np.concatenate([k for _, k, _ in held]), np.concatenate([o + a for (_, _, o), a in zip(held, first)])

    for batch in batches:
        word, of = _texts(batch, 1)
        if held and (sum(len(k) for _, k, _ in held) + len(word) > GROUP or sum(len(h) for h, _, _ in held) + batch.num_rows >= 1 << 16):
            yield closed()
            held = []
        held.append((batch.column(0).to_numpy(), _keys(word, of), of))
    if held:
        yield closed()


def _cells(context: np.ndarray) -> np.ndarray:
    return (mix(context, 11) >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _cell_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << CELL_BITS, np.int64)
    for _, key, _ in _groups(batches):
        counts += np.bincount(_cells(key >> _WORD_BITS), minlength=len(counts))
    yield from _parts(list(_segments(0, counts)))


def _in_full_cells(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keys whose contexts lie in full cells, and their counts in a group."""
        for _, key, _ in _groups(batches):
            key, n = np.unique(key[shared.value[_cells(key >> _WORD_BITS)]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

    return run


def _pack(x: np.ndarray) -> bytes:
    """Bytes of the numbers by their place within a number, compressed."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), "zstd", asbytes=True)


def _unpack(data: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, n * size, "zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _sizes(new: np.ndarray) -> np.ndarray:
    """Of each place, the size of its run. new: whether a run begins."""
    size = np.diff(np.r_[np.flatnonzero(new), len(new)])
    return np.repeat(size, size)


def _changes(x: np.ndarray) -> np.ndarray:
    return np.r_[np.ones(min(len(x), 1), bool), x[1:] != x[:-1]]


def _times(code: np.ndarray) -> np.ndarray:
    """How often each number occurs."""
    order = np.sort(code)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return np.ones(len(code), np.int64)
    value, n = np.unique(twice, return_counts=True)
    at = np.minimum(np.searchsorted(value, code), len(value) - 1)
    return np.where(value[at] == code, n[at] + 1, 1)


def _among(sorted_ones: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each is one of the sorted ones, and which."""
    if not len(sorted_ones):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(sorted_ones, x), len(sorted_ones) - 1)
    return sorted_ones[at] == x, at


def _log_shares(of_word: np.ndarray, n: np.ndarray, of_context: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Log-probabilities of words by the places of other texts, in units of 2**-FRACTION: whole numbers, whose sums don't depend on their order."""
    return np.rint((np.log(of_word - n + UNIFORM / (1 << BIN_BITS)) - np.log(of_context - m + UNIFORM)) * (1 << FRACTION))


_DEALT = "part int, group long, n int, texts binary, keys binary, places binary, own binary, sums binary"
_ADDED = "group long, n int, texts binary, places binary, sums binary, own binary"


def _deal(shared, parts: int):
    """Places of each group by the part that counts them: a context's as a whole, those of a frequent context by word too, which bring
    how often their text has the context. Places whose word is frequent between its neighbours are scored here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts, context_counts, pairs, pair_counts = shared.value
        task = TaskContext.get().partitionId() if TaskContext.get() else 0

        def rows(number: int, key: np.ndarray, of: np.ndarray, by: np.ndarray, own: np.ndarray | None) -> Iterator[tuple]:
            order = np.argsort(key, kind="stable")
            part = ((mix(by[order], 13) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.uint16 if parts <= 1 << 16 else np.int64)
            to = np.argsort(part, kind="stable")
            order, part = order[to], part[to]
            edges = np.flatnonzero(np.r_[_changes(part), True]).tolist() if len(part) else []
            for a, b in zip(edges[:-1], edges[1:]):
                mine = order[a:b]
                yield (
                    int(part[a]), number, b - a, None, _pack(np.diff(key[mine], prepend=np.uint64(0))), _pack(of[mine].astype(np.uint16)),
                    None if own is None else _pack(own[mine].astype(np.uint32)), None,
                )

        for i, (h, key, of) in enumerate(_groups(batches)):
            number = (task << 32) + i
            context = key >> _WORD_BITS
            sums = np.zeros(len(h))
            out: list[tuple] = []
            many, at = _among(contexts, context)
            if many.any():
                hot, hot_of, at = key[many], of[many], at[many]
                own = _times(at.astype(np.uint64) << np.uint64(16) | hot_of.astype(np.uint64))
                known, pair = _among(pairs, hot)
                if known.any():
                    n = _times(pair[known].astype(np.uint64) << np.uint64(16) | hot_of[known].astype(np.uint64))
                    sums = np.bincount(hot_of[known], _log_shares(pair_counts[pair[known]], n, context_counts[at[known]], own[known]), len(h))
                rest = ~known
                out += rows(number, hot[rest], hot_of[rest], hot[rest], own[rest])
                few = ~many
                out += rows(number, key[few], of[few], context[few], None)
            else:
                out += rows(number, key, of, context, None)
            places = np.bincount(of, minlength=len(h)).astype(np.int64)
            out.append((number % parts, number, len(h), h.tobytes(), None, None, _pack(places), _pack(sums.astype(np.int64))))
            for a in range(0, len(out), 32):
                yield _batch(out[a : a + 32], _DEALT)

    return run


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names, types = zip(*(x.split() for x in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, k in zip(zip(*rows), types)], list(names))


def _count_parts(shared):
    """Sums of each group's texts over the places of a part, of which a task has all. What has been scored passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts, context_counts = shared.value[:2]
        held: dict[bool, list[tuple]] = {False: [], True: []}
        for batch in batches:
            for _, group, n, texts, keys, places, own, sums in zip(*(c.to_pylist() for c in batch.columns)):
                if texts is not None:
                    yield _batch([(group, n, texts, None, sums, own)], _ADDED)
                else:
                    held[own is not None].append((group, n, keys, places, own))
        for hot, rows in held.items():
            if not rows:
                continue
            key = np.concatenate([np.cumsum(_unpack(r[2], r[1], np.uint64), dtype=np.uint64) for r in rows])
            place = [_unpack(r[3], r[1], np.uint16) for r in rows]
            first = np.cumsum([0, *(int(x.max()) + 1 for x in place)])
            text = np.concatenate([x.astype(np.uint32) + np.uint32(a) for x, a in zip(place, first)])
            order = np.argsort(key, kind="stable")  # keys of a row come with ascending texts
            key, text = key[order], text[order]
            new = _changes(key)
            of_word, n = _sizes(new), _sizes(new | _changes(text))
            if hot:
                of_context = context_counts[_among(contexts, key >> _WORD_BITS)[1]]
                m = np.concatenate([_unpack(r[4], r[1], np.uint32) for r in rows])[order].astype(np.int64)
            else:
                new = _changes(key >> _WORD_BITS)
                of_context = _sizes(new)
                m = _times((np.cumsum(new).astype(np.uint64) << np.uint64(32)) | text.astype(np.uint64))
            sums = np.bincount(text, _log_shares(of_word, n, of_context, m), first[-1]).astype(np.int64)
            seen = np.bincount(text, minlength=first[-1]) > 0
            out = []
            for (group, *_), a, b in zip(rows, first[:-1].tolist(), first[1:].tolist()):
                mine = np.flatnonzero(seen[a:b])
                out.append((group, len(mine), None, _pack(mine.astype(np.uint16)), _pack(sums[a:b][mine]), None))
            for a in range(0, len(out), 32):
                yield _batch(out[a : a + 32], _ADDED)

    return run


def _add_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h, number of places and mean of each text; the rows of a group come together."""
    last, head, held = None, None, []

    def closed() -> pa.RecordBatch:
        n, texts, sums, own = head
        total, places = _unpack(sums, n, np.int64), _unpack(own, n, np.int64)
        for k, at, part in held:
            total[_unpack(at, k, np.uint16)] += _unpack(part, k, np.int64)
        some = places > 0
        mean = total[some] / (1 << FRACTION) / places[some]
        return pa.RecordBatch.from_arrays([pa.array(np.frombuffer(texts, np.int64)[some]), pa.array(places[some]), pa.array(mean)], ["h", "n", "mean"])

    for batch in batches:
        for group, n, texts, places, sums, own in zip(*(c.to_pylist() for c in batch.columns)):
            if group != last and last is not None:
                yield closed()
                held = []
            last = group
            if texts is not None:
                head = (n, texts, sums, own)
            else:
                held.append((n, places, sums))
    if last is not None:
        yield closed()


def _frequent(texts: DataFrame, cells: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Contexts of more than so many places and their counts, and the same of contexts with a word. Only full cells can have any."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if not (cells > least).any():
        return *none, *none
    full = texts.sparkSession.sparkContext.broadcast(cells > least)
    pairs = arrow(texts.select("h", "words"), _in_full_cells(full), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    pairs = table(pairs, "pairs")
    whole = pairs.groupBy(F.shiftright("key", BIN_BITS).alias("key")).agg(F.sum("n").alias("n"))
    out: list[np.ndarray] = []
    for frame in (whole, pairs):
        rows = sorted(frame.filter(F.col("n") > least).collect())  # fewer than all places / least
        out += [np.array([r["key"] for r in rows], np.uint64), np.array([r["n"] for r in rows], np.int64)]
    drop_table(pairs)
    return tuple(out)


def by_other_texts(texts: DataFrame, parts: int | None = None) -> DataFrame:
    """h, places of the text, and the mean log-probability of their words by the places of all other texts with the same neighbours. Every place counts."""
    spark = texts.sparkSession
    source = texts.select("h", "words")
    (cells,) = _gathered(arrow(source, _cell_counts, _SUMS), [(1 << CELL_BITS,)])
    parts = parts or max(width(spark), int(cells.sum()) // PART_PLACES + 1)
    frequent = _frequent(texts, cells, int(cells.sum()) // (4 * parts))
    shared = spark.sparkContext.broadcast(frequent)
    dealt_out = arrow(source, _deal(shared, parts), _DEALT).repartitionById(parts, F.col("part"))
    added = arrow(dealt_out, _count_parts(shared), _ADDED).repartition(width(spark), "group").sortWithinPartitions("group")
    rows = arrow(added, _add_texts, "h long, n long, mean double")
    # repeated rows have equal results
    return table(rows.groupBy("h").agg(F.max("n").alias("n_contexts"), F.max("mean").alias("context_log_likelihood")), "by_others")


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of all texts under the network that they train, and by the counts of the other texts."""
    texts = dealt(docs, id_col, text_col)
    out = score(texts, fit(texts), id_col).join(by_other_texts(texts), "h", "left")
    none = float(-np.log(1 << BIN_BITS))
    return out.select(
        id_col, "n_tokens", "pseudo_log_likelihood", "mean_log_likelihood", F.coalesce("n_contexts", F.lit(0)).cast("long").alias("n_contexts"),
        F.coalesce("context_log_likelihood", F.lit(none)).alias("context_log_likelihood"),
    )
