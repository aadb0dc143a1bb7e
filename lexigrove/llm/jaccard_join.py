"""Exact Jaccard join (0.75 or more) of word shingle sets by PartEnum signatures.

Similar enough sets of n and of at least as many elements differ by at most n // 3 elements. Two levels, as
in PartEnum: the domain of shingle hashes is cut into groups of three partitions, as many as the size
band asks for, and of each group the subsets of two partitions are enumerated; a signature is such a subset with
the hash of the set's elements in it, if there are any. To leave two sets without a common signature of a
group, their differences must lie in two of its partitions, or in one if only one holds elements. A set
enumerates groups in their order until more than n // 3 differences would be needed: two similar sets then
share one signature, whichever of them stops first. Sets near the upper end of their band enumerate the
next band's groups, too. Sets whose groups don't suffice also enumerate their first n // 3 + 1 single elements.

Signatures of very many sets (common passages) are passed over by all sets alike, and further
groups are enumerated for them, which keeps the guarantee. The list of such signatures is bounded; it decides
only how fast the join is, never what it finds.

Equal sets collapse before. Parities of the numbers of elements in buckets bound how much two sets
differ from below. Within the sets of a signature, possible links that span all others come
first and are verified on the whole sets; then those that would still join two components
are, found by more parity bits. No pairs leave a task but these. Long lists of sets are dealt out as
pairs of blocks, so no task holds one whole.

Texts without words (or null) have empty sets and link with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components, forest
from .shared import arrow, drop_table, table, width
from .textwords import LOWER, WHITE, mix, pieces, spans, word_hashes

WORDS = 5
#: Sizes of a band: from a power of RATIO to the next. Partitions of a group, and partitions for each element of a band's smallest set.
RATIO, GROUP, EACH = 4, 3, 2.5
#: A signature of so many sets is passed over; at most so many are; a task reports those it met so often.
COMMON, MOST_COMMON, REPORTED = 64, 100_000, 2
#: Signatures that a task counts together and that it holds for dealing out, signatures of a bucket about, parity bits for each element, sets of a list that one task compares.
COUNTED, HELD, BUCKET, COARSE, FINE, BLOCK = 1 << 21, 1 << 20, 1 << 15, 1, 8, 1024
#: Parity bits of a set for each of these at most: beyond about twice as many elements they rule nothing out.
MOST_BITS = 1 << 13
#: Edges that a task holds before it looks for those that span them.
EDGES = 1 << 18


def shingle_sets(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    start, end, of = spans(LOWER[data], at, WHITE)
    word = word_hashes(data, start, end)
    count = np.bincount(of, minlength=len(at) - 1)
    first = np.cumsum(count) - count
    joined = np.zeros(0, np.uint64)
    if len(word) >= WORDS:
        joined = word[: len(word) - WORDS + 1].copy()
        for k in range(1, WORDS):
            joined = mix(joined * np.uint64(0x9E3779B97F4A7C15) + word[k : len(word) - WORDS + 1 + k], k)
    out = []
    for a, n in zip(first.tolist(), count.tolist()):
        if n >= WORDS:
            own = np.sort(joined[a : a + n - WORDS + 1])
            out.append(own[np.r_[True, own[1:] != own[:-1]]])
        elif n:
            whole = xxhash.xxh3_64_intdigest(word[a : a + n].tobytes())
            out.append(np.array([whole], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_id(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def schemes(n: int) -> list[int]:
    """Numbers of partitions that a set of n elements is cut into."""
    band = 1
    while n >= band * RATIO:
        band *= RATIO
    cut = lambda b: GROUP * -(-int(EACH * b) // GROUP)
    return [cut(band), cut(band * RATIO)] if 4 * n >= 3 * band * RATIO else [cut(band)]


def subsets(s: np.ndarray, scheme: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each group with elements, in the order of the domain: the signature of the subset without each of its partitions, and whether it has elements."""
    part = ((s >> np.uint64(32)) * np.uint64(scheme)) >> np.uint64(32)
    first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    content = mix(np.add.reduceat(mix(s, 31), first), scheme) | np.uint64(1)
    part = part[first].astype(np.int64)
    group = part // GROUP
    begins = np.r_[True, group[1:] != group[:-1]]
    held = np.zeros((int(begins.sum()), GROUP), np.uint64)
    held[np.cumsum(begins) - 1, part % GROUP] = content
    without = np.stack([held[:, (e + 1) % GROUP] * np.uint64(3) + held[:, (e + 2) % GROUP] * np.uint64(5) for e in range(GROUP)], 1)
    number = (group[begins].astype(np.uint64) * np.uint64(GROUP))[:, None] + np.arange(GROUP, dtype=np.uint64)
    return mix(without + number * np.uint64(0x9E3779B97F4A7C15), scheme), without != 0


def _within(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is in a sorted array."""
    if not len(known):
        return np.zeros(values.shape, bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def signatures(s: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of subsets, and of single elements where the subsets don't suffice."""
    out, need, short = [], len(s) // 3 + 1, False
    for scheme in schemes(len(s)):
        value, usable = subsets(s, scheme)
        usable &= ~_within(value, common)
        reached = np.cumsum(np.where(usable.all(1), 2, usable.any(1)))
        stop = int(np.searchsorted(reached, need)) + 1
        short |= stop > len(reached)
        out.append(value[:stop][usable[:stop]])
    single = np.zeros(0, np.uint64)
    if short:
        single = mix(s, 77)
        often = _within(single, common)
        single = np.r_[single[~often], single[often]][:need]
    return np.concatenate(out), single


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind 0: set, size and parities of a row; kind 1: a signature that this task met often."""
    seen: set[int] = set()
    held: list[np.ndarray] = []
    n_held = 0

    def frequent() -> pa.RecordBatch:
        value, count = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        often = count >= REPORTED
        k = int(often.sum())
        columns = [
            pa.array([1] * k, pa.int8()), pa.nulls(k, id_type), pa.array(value[often].view(np.int64)),
            pa.array(count[often], pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, names)

    names = ["kind", "id", "a", "b", "counts", "fine"]
    id_type = pa.int64()
    for batch in batches:
        id_type = batch.column(0).type
        ids, sizes, coarse, fine = [], [], [], []
        for _, data, at in pieces(batch.column(1)):
            for s in shingle_sets(data, at):
                own = set_id(s)
                ids.append(own)
                sizes.append(len(s))
                coarse.append(parities(s, COARSE))
                fine.append(parities(s, FINE))
                if len(s) and own not in seen:
                    seen.add(own)
                    for scheme in schemes(len(s)):
                        value, there = subsets(s, scheme)
                        held.append(value[there])
                        n_held += len(held[-1])
        columns = [
            pa.array([0] * len(ids), pa.int8()), batch.column(0), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()),
            pa.array(coarse, pa.binary()), pa.array(fine, pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names)
        if len(seen) > 1 << 18:
            seen = set()
        if n_held > COUNTED:
            yield frequent()
            held, n_held = [], 0
    yield frequent()


def _second_pass(common, buckets: int):
    """Signatures of subsets by bucket (their high half and the sets that have them), and single elements (whole), which are dealt with their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
        owner: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
        n_held = 0
        known = common.value

        def dealt(k: int) -> pa.RecordBatch | None:
            if not held[k]:
                return None
            signature, member = np.concatenate(held[k]), np.concatenate(owner[k])
            spread = mix(signature ^ member.view(np.uint64), 5) if k else signature
            bucket = (spread % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            signature, member, bucket = signature[order], member[order], bucket[order]
            first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            last = np.r_[first[1:], len(bucket)]
            if not k:
                signature = (signature >> np.uint64(32)).astype(np.uint32)
            blobs = [(signature[a:b].tobytes(), member[a:b].tobytes()) for a, b in zip(first, last)]
            columns = [
                pa.array(bucket[first]), pa.array([bool(k)] * len(first)), pa.array([x for x, _ in blobs], pa.binary()),
                pa.array([x for _, x in blobs], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["bucket", "single", "signatures", "members"])

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal held, owner, n_held
            for k in (0, 1):
                if (out := dealt(k)) is not None:
                    yield out
            held, owner, n_held = ([], []), ([], []), 0

        for batch in batches:
            for _, data, at in pieces(batch.column(0)):
                for s in shingle_sets(data, at):
                    own = set_id(s)
                    if not len(s) or own in seen:
                        continue
                    seen.add(own)
                    for k, found in enumerate(signatures(s, known)):
                        if len(found):
                            held[k].append(found)
                            owner[k].append(np.full(len(found), own, np.int64))
                            n_held += len(found)
                if n_held > HELD:
                    yield from closed()
            if len(seen) > 1 << 18:
                seen = set()
        yield from closed()

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """g and sets: distinct lists of two or more sets that share a signature, from rows sorted by bucket; of single elements each set alone."""
    held: list[tuple[bytes, bytes]] = []
    last = None
    met: set[bytes] = set()

    def made(group: list, members: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(group, pa.int64()), pa.array(members, pa.list_(pa.int64()))], ["g", "members"])

    def closed() -> pa.RecordBatch:
        signature = np.concatenate([np.frombuffer(x, np.uint32) for x, _ in held])
        member = np.concatenate([np.frombuffer(x, np.int64) for _, x in held])
        order = np.lexsort((member, signature))
        signature, member = signature[order], member[order]
        own = np.r_[True, (signature[1:] != signature[:-1]) | (member[1:] != member[:-1])]
        signature, member = signature[own], member[own]
        first = np.flatnonzero(np.r_[True, signature[1:] != signature[:-1]])
        stop = np.r_[first[1:], len(signature)]
        group, members = [], []
        for g in np.flatnonzero(stop - first > 1):
            sets = member[first[g] : stop[g]]
            raw = sets.tobytes()
            code = xxhash.xxh3_128_digest(raw)
            if code not in met:
                met.add(code)
                group.append(xxhash.xxh3_64_intdigest(raw) - (1 << 63))
                members.append(sets.tolist())
        if len(met) > 1 << 18:
            met.clear()
        return made(group, members)

    for batch in batches:
        for bucket, single, *blobs in zip(*(c.to_pylist() for c in batch.columns)):
            if single:
                yield made(np.frombuffer(blobs[0], np.int64).tolist(), np.frombuffer(blobs[1], np.int64).reshape(-1, 1).tolist())
                continue
            if bucket != last and held:
                yield closed()
                held = []
            last = bucket
            held.append(tuple(blobs))
    if held:
        yield closed()


class _Members:
    """The sets of all lists of a batch, flat, with what bounds their differences."""

    def __init__(self, batch: pa.RecordBatch):
        self.group = batch.column(0).to_numpy()
        self.length = batch.column(1).value_lengths().to_numpy().astype(np.int64)
        self.sets, self.sizes, self.more, self.side = (batch.column(i).flatten().to_numpy() for i in (1, 2, 4, 5))
        counted = batch.column(3).flatten()
        self.width = np.array([len(c) for c in counted.to_pylist()], np.int64)
        self.at = np.zeros(len(self.sets), np.int64)
        self.full, self.half = {}, {}
        for w in np.unique(self.width).tolist():
            own = np.flatnonzero(self.width == w)
            self.at[own] = np.arange(len(own))
            x = np.frombuffer(b"".join(counted.take(pa.array(own)).to_pylist()), np.uint64).reshape(-1, w // 8)
            self.full[w], self.half[w] = x, x[:, : w // 16] ^ x[:, w // 16 :]

    def may_link(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For pairs of places: False only if the sets differ too much for a link."""
        n, m = self.sizes[i], self.sizes[j]
        out = 4 * np.minimum(n, m) >= 3 * np.maximum(n, m)
        wi, wj = self.width[i], self.width[j]
        for w in self.full:
            for v in (w // 2, w, 2 * w):
                mine = np.flatnonzero(out & (wi == w) & (wj == v)) if v in self.full else ()
                if len(mine):
                    x = (self.half if v < w else self.full)[w][self.at[i[mine]]]
                    y = (self.half if v > w else self.full)[v][self.at[j[mine]]]
                    out[mine] = 7 * np.bitwise_count(x ^ y).sum(1, dtype=np.int64) <= n[mine] + m[mine]
        return out

    def pairs(self, most: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of all pairs within lists, in bounded blocks; where two blocks of a list meet, of pairs between them."""
        for i, j in self._pairs(most):
            meets = (self.side[i] < 0) | (self.side[i] != self.side[j])
            yield (i, j) if meets.all() else (i[meets], j[meets])

    def _pairs(self, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Near places first, of all lists of one length together."""
        first = np.cumsum(self.length) - self.length
        for m in np.unique(self.length).tolist():
            own = first[self.length == m]
            step = max(1, most // max(1, m))
            for d in range(1, m, step):
                apart = np.arange(d, min(m, d + step))
                i = np.concatenate([np.arange(m - k) for k in apart])
                j = i + np.repeat(apart, m - apart)
                lists = max(1, most // len(i))
                for k in range(0, len(own), lists):
                    yield (own[k : k + lists, None] + i).ravel(), (own[k : k + lists, None] + j).ravel()


def _emit(rows: list[np.ndarray]) -> pa.RecordBatch:
    made = np.unique(np.concatenate(rows), axis=0) if rows else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(made[:, 0]), pa.array(made[:, 1])], ["a", "b"])


def _pairs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.stack([np.minimum(x, y), np.maximum(x, y)], 1)


def spanning(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Places of edges that connect what all edges connect; in each round every component takes one, between near numbers first, so that none is in many."""
    _, at = np.unique(np.r_[i, j], return_inverse=True)
    label = np.arange(at.max(initial=-1) + 1)
    left, right, chosen = at[: len(i)], at[len(i) :], []
    open_ones = np.argsort(np.abs(left - right), kind="stable")
    while True:
        x, y = label[left[open_ones]], label[right[open_ones]]
        apart = x != y
        open_ones, x, y = open_ones[apart], x[apart], y[apart]
        if not len(open_ones):
            return np.unique(np.concatenate(chosen)) if chosen else open_ones
        _, first = np.unique(np.stack([x, y], 1).ravel(), return_index=True)
        pick = np.unique(first // 2)
        chosen.append(open_ones[pick])
        node, root = forest(x[pick], y[pick])
        to = np.arange(len(label))
        to[node] = root
        label = to[label]


class _Spanned:
    """Links of a task (rows of two sets and of their components) that connect all components which any links connect."""

    def __init__(self) -> None:
        self.links = np.zeros((0, 4), np.int64)

    def roots(self, components: np.ndarray) -> np.ndarray:
        """Each component's least one among those connected so far."""
        return _replaced(components, *forest(self.links[:, 2], self.links[:, 3]))

    def add(self, links: np.ndarray) -> None:
        both = np.concatenate([self.links, links])
        self.links = both[spanning(both[:, 2], both[:, 3])]


def _replaced(values: np.ndarray, known: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Values, those in known (sorted) replaced."""
    if not len(known):
        return values
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[at] == values, by[at], values)


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Possible links between sets of different components (more) that connect all that possible links within the task's lists connect.

    Pairs whose components are connected already are not compared, so a group of near copies costs little more than a chain.
    """
    held = _Spanned()
    for batch in batches:
        own = _Members(batch)
        ids, at = np.unique(own.more, return_inverse=True)
        label = held.roots(ids)
        found = [np.zeros((0, 4), np.int64)]
        for i, j in own.pairs():
            open_ones = label[at[i]] != label[at[j]]
            i, j = i[open_ones], j[open_ones]
            keep = own.may_link(i, j)
            i, j = i[keep], j[keep]
            if len(i):
                x, y = label[at[i]], label[at[j]]
                pick = spanning(x, y)
                found.append(np.concatenate([_pairs(own.sets[i[pick]], own.sets[j[pick]]), np.stack([own.more[i[pick]], own.more[j[pick]]], 1)], 1))
                label = _replaced(label, *forest(x[pick], y[pick]))
        held.add(np.concatenate(found))
        if len(held.links) > EDGES:
            yield _emit([held.links[:, :2]])
            held = _Spanned()
    yield _emit([held.links[:, :2]])


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """List and set of those with a possible link to another component in their list."""
    for batch in batches:
        own = _Members(batch)
        linked = np.zeros(len(own.sets), bool)
        for i, j in own.pairs():
            apart = own.more[i] != own.more[j]
            i, j = i[apart], j[apart]
            keep = own.may_link(i, j)
            linked[i[keep]] = linked[j[keep]] = True
        group = np.repeat(own.group, own.length)
        yield pa.RecordBatch.from_arrays([pa.array(group[linked]), pa.array(own.sets[linked])], ["g", "set"])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Possible links between sets of different components, each once for a task."""
    found: list[np.ndarray] = []
    size = 0
    for batch in batches:
        own = _Members(batch)
        for i, j in own.pairs():
            apart = own.more[i] != own.more[j]
            i, j = i[apart], j[apart]
            keep = own.may_link(i, j)
            found.append(_pairs(own.sets[i[keep]], own.sets[j[keep]]))
            size += len(found[-1])
            if size > EDGES:
                yield _emit(found)
                found, size = [], 0
    yield _emit(found)


def parities(s: np.ndarray, each: int) -> bytes:
    """Whether the number of elements in each of at least each * len(s) buckets is odd: as many bits, a power of two, MOST_BITS * each at most."""
    bits = 128 * each
    while bits < min(each * len(s), each * MOST_BITS):
        bits *= 2
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            both = np.sort(np.r_[np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
            shared = int((both[1:] == both[:-1]).sum())
            keep.append(100 * shared >= 75 * (len(both) - shared))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).filter(pa.array(keep, pa.bool_())), batch.column(1).filter(pa.array(keep, pa.bool_()))],
            ["a", "b"],
        )


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    left, right = (sets.select(F.col("set").alias(k), F.col("elements").alias(f"e{k}")) for k in "ab")
    return arrow(pairs.join(left, "a").join(right, "b").select("a", "b", "ea", "eb"), _linked, "a long, b long")


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        wanted = batch.column(0).to_pylist()
        for row, data, at in pieces(batch.column(1)):
            for i, s in enumerate(shingle_sets(data, at)):
                if set_id(s) == wanted[row + i]:
                    rows.append((wanted[row + i], s.tobytes()))
        columns = list(zip(*rows)) or [[]] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.binary()))], ["set", "elements"])


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles and component_id: the least id that links reach, its own included (null ids are passed over)."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    first = table(arrow(rows, _first_pass, f"kind tinyint, id {kind}, a long, b long, counts binary, fine binary"), "sets")
    often = first.filter("kind = 1").groupBy("a").agg(F.sum("b").alias("n")).filter(F.col("n") >= COMMON)
    often = [r["a"] for r in often.orderBy(F.desc("n"), "a").limit(MOST_COMMON).select("a").collect()]
    common = spark.sparkContext.broadcast(np.sort(np.array(often, np.int64).view(np.uint64)))
    owned = first.filter("kind = 0").select("id", F.col("a").alias("set"), F.col("b").alias("n_shingles"))
    sizes = first.filter("kind = 0 AND b > 0").groupBy(F.col("a").alias("set")).agg(
        F.first("b").alias("n"), F.first("counts").alias("counts"), F.min("id").alias("one"),
    )
    parts = width(spark)
    total = sizes.agg(F.sum(F.col("n") * 0.6 + 2)).first()[0] or 0
    buckets = max(parts, int(total // BUCKET) + 1)
    dealt = arrow(rows.select("text"), _second_pass(common, buckets), "bucket int, single boolean, signatures binary, members binary")
    dealt = dealt.repartition(parts, "bucket").sortWithinPartitions("bucket")
    lists = arrow(dealt, _groups, "g long, members array<long>").distinct()
    members = table(lists.select("g", F.explode("members").alias("set")), "members")

    def unsettled(rows_of: DataFrame, whole: DataFrame) -> DataFrame:
        """Rows (g, set) of the lists with sets of two components or more, with the component of each. A table: plans that read it stay small."""
        labelled = rows_of.join(whole.withColumnRenamed("node", "set"), "set", "left").select("g", "set", F.coalesce("component", "set").alias("component"))
        several = labelled.groupBy("g").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high")
        return table(labelled.join(several.select("g"), "g"), "open")

    def gathered(rows_of: DataFrame, known: DataFrame, more: Column) -> DataFrame:
        """Lists of two or more sets with their sizes and parities (known); of longer ones than BLOCK every pair of blocks.

        side: the block of a set where two meet, else -1. Sizes and parities join last, so they are shuffled once.
        """
        long = rows_of.groupBy("g").agg(F.count(F.lit(1)).alias("many")).filter(F.col("many") > BLOCK)
        blocks = F.coalesce(F.ceil(F.col("many") / BLOCK), F.lit(1)).cast("int")
        dealt_out = rows_of.withColumn("more", more).join(long, "g", "left").withColumn("blocks", blocks)
        dealt_out = dealt_out.withColumn("own", F.pmod(F.xxhash64(F.lit(7), "set"), F.col("blocks")).cast("int"))
        dealt_out = dealt_out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        side = F.when(F.col("own") == F.col("other"), F.lit(-1)).otherwise(F.col("own"))
        dealt_out = dealt_out.select("g", "set", "more", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), side.alias("side"))
        one = F.struct("set", "n", "counts", "more", "side")
        # rows of one set stay side by side, which packs its parities well
        whole = dealt_out.join(known.select("set", "n", "counts"), "set").repartition(parts, "g", "low", "high")
        listed = whole.groupBy("g", "low", "high").agg(F.collect_list(one).alias("x"))
        return listed.filter(F.size("x") > 1).select("g", "x.set", "x.n", "x.counts", "x.more", "x.side")

    def merged(rows_of: DataFrame, whole: DataFrame) -> DataFrame:
        """Rows (g, set), where all sets of what possible links connect (within) stand as one list if that has fewer pairs than its lists have together."""
        placed = table(rows_of.join(whole, "set").select("g", "set", "within"), "placed")
        lists_of = placed.groupBy("within", "g").agg(F.count(F.lit(1)).cast("double").alias("n"))
        cost = lists_of.groupBy("within").agg(F.sum(F.col("n") * F.col("n")).alias("cost"))
        size = placed.select("within", "set").distinct().groupBy("within").agg(F.count(F.lit(1)).cast("double").alias("m"))
        cheaper = table(cost.join(size, "within").filter(F.col("m") * F.col("m") <= F.col("cost")).select("within"), "cheaper")
        one = placed.join(cheaper, "within").select(F.xxhash64(F.lit(5), "within").alias("g"), "set").distinct()
        return one.unionByName(placed.join(cheaper, "within", "left_anti").select("g", "set"))

    # a first look at two lists of each set connects most near copies; lists within what it connects need no more looks
    some = members.groupBy("set").agg(F.array_distinct(F.array(F.min("g"), F.max("g"))).alias("g")).select(F.explode("g").alias("g"), "set")
    near = table(arrow(gathered(some, sizes, F.col("set")), _trees, "a long, b long").distinct(), "near")
    nearly = table(components(near), "components")
    open_ones = unsettled(members, nearly)
    likely = near.union(arrow(gathered(open_ones, sizes, F.col("component")), _trees, "a long, b long"))
    likely = table(likely.distinct(), "likely")
    drop_table(open_ones)
    involved = likely.select(F.explode(F.array("a", "b")).alias("set")).distinct()
    involved = sizes.join(involved, "set").select("set", "one")
    texts = rows.join(involved, F.col("id").eqNullSafe(F.col("one"))).select("set", "text")
    sets = arrow(texts, _elements, "set long, elements binary")
    sets = table(sets.groupBy("set").agg(F.first("elements").alias("elements")), "elements")
    links = table(_verified(likely, sets), "links")
    known = table(components(links), "components")
    # possible links lie within what possible links connect: only there can links to another component be left
    possible = table(components(likely).select(F.col("node").alias("set"), F.col("component").alias("within")), "possible")
    inside = members.join(possible, "set").select(F.xxhash64("g", "within").alias("g"), "set")
    open_ones = unsettled(inside, known)
    apart = gathered(open_ones, sizes, F.col("component"))
    apart = table(arrow(apart, _apart, "g long, set long").distinct(), "apart")
    drop_table(open_ones)
    fine = first.filter("kind = 0 AND b > 0").join(apart.select(F.col("set").alias("a")).distinct(), "a", "left_semi")
    fine = fine.groupBy(F.col("a").alias("set")).agg(F.first("b").alias("n"), F.first("fine").alias("counts"))
    open_ones = unsettled(merged(apart, possible), known)
    rest = arrow(gathered(open_ones, fine, F.col("component")), _across, "a long, b long").distinct()
    more = table(_verified(rest.join(likely, ["a", "b"], "left_anti"), sets), "links")
    drop_table(open_ones)
    final = table(components(links.union(more)), "components")
    grouped = owned.join(final, owned["set"] == final["node"], "left").select("id", "n_shingles", F.coalesce("component", "set").alias("component"))
    least = grouped.filter("n_shingles > 0").groupBy("component").agg(F.min("id").alias("component_id"))
    out = grouped.join(least, "component", "left")
    return out.select(
        F.col("id").alias(id_col), "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of the least id of each class; rows without words or without id stay."""
    found = classes(docs, id_col, text_col)
    gone = found.filter(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    stay = found.filter(F.col(id_col) == F.col("component_id")).select(id_col).distinct()
    return docs.join(gone.join(stay, id_col, "left_anti"), id_col, "left_anti").select(*docs.columns)
