"""Jaccard join and components against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lexigrove.llm import components as C
from lexigrove.llm import jaccard_join as J
from lexigrove.llm.components import components, forest


def shingles(text):
    ws = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return frozenset(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) if ws else frozenset()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            n, m = len(sets[i]), len(sets[j])
            if n and m and 4 * min(n, m) >= 3 * max(n, m):
                both = len(sets[i] & sets[j])
                if 100 * both >= 75 * (n + m - both):
                    root[find(i)] = find(j)
    out = []
    for i, (key, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((key, len(sets[i]), (min(ids) if ids else None) if sets[i] else key))
    return sorted(out, key=str)


def thue_morse(rounds=11):
    """A word and its complement, whose running sums modulo 2**64 are equal for any odd base."""
    word = "a"
    swapped = str.maketrans("ab", "ba")
    for _ in range(rounds):
        word += word.translate(swapped)
    return word, word.translate(swapped)


def near_copies(seed, n):
    r = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(60))
    base = [[f"w{r.randrange(10**6)}" for _ in range(r.choice([3, 8, 30, 70, 260, 300, 340, 1100]))] for _ in range(14)]
    rows = [
        (None, "A b c d E f"), (None, None), (5000, "a B c d e f"), (5001, ""), (5002, " \n"), (5003, "Ä b c d e f"),
        (7, "same id"), (7, "same id"), (7, "other words under that id"),
    ]
    rows += [(6000 + i, " ".join([w, w, w, "b", "c", w])) for i, w in enumerate(thue_morse())]
    for i in range(n):
        words = list(r.choice(base))
        for _ in range(int(len(words) * r.choice([0, 0.005, 0.02, 0.04, 0.06]))):
            words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
        if r.random() < 0.5:
            words.insert(r.randrange(len(words) + 1), passage)
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("common,block", [(64, 1024), (3, 8), (2, 4)])
def test_equals_brute_force(spark, monkeypatch, common, block):
    """Where signatures of two or three sets are passed over, many sets fall back on single elements."""
    monkeypatch.setattr(J, "COMMON", common)
    monkeypatch.setattr(J, "BLOCK", block)
    rows = near_copies(common, 140)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, id int").repartition(3)
    got = sorted(map(tuple, J.classes(docs).collect()), key=str)
    assert got == brute(rows)


def test_a_table_and_one_of_each(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows)
    assert sorted(map(tuple, J.classes(docs).collect()), key=str) == want
    assert sorted(r.doc_id for r in J.one_of_each(docs).collect()) == sorted(i for i, _, c in want if i == c)
    assert J.classes(docs.limit(0)).count() == 0


def test_similar_sets_share_a_signature():
    random = np.random.default_rng(3)
    for n in [1, 2, 3, 7, 100, 191, 192, 255, 256, 300, 767, 768, 1023, 1024, 1500]:
        for _ in range(30):
            a = random.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64) * np.uint64(2)
            gone = int(random.integers(0, n // 7 + 1))
            b = np.r_[a[gone:], random.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64)[: max(0, n // 7 - gone)]]
            a, b = np.unique(a), np.unique(b)
            both = len(np.intersect1d(a, b))
            if 100 * both < 75 * (len(a) + len(b) - both):
                continue
            everything = np.unique(np.concatenate([J.subsets(x, k)[0].ravel() for x in (a, b) for k in J.schemes(len(x))]))
            for common in (np.zeros(0, np.uint64), everything[::2], everything):
                (x, single_x), (y, single_y) = J.signatures(a, common), J.signatures(b, common)
                assert len(np.intersect1d(x, y)) or len(np.intersect1d(single_x, single_y))
            each = int(random.choice([J.COARSE, J.FINE]))
            listed = [[1, 2], [len(a), len(b)], [J.parities(a, each), J.parities(b, each)], [0, 0], [-1, -1]]
            kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64())]
            batch = pa.RecordBatch.from_arrays([pa.array([5]), *(pa.array([x], k) for x, k in zip(listed, kinds))], list("gsncod"))
            assert J._Members(batch).may_link(np.array([0, 1]), np.array([1, 0])).all()


def test_spanning_edges_of_a_clique_are_no_star():
    i, j = np.triu_indices(200, 1)
    pick = J.spanning(i, j)
    assert len(pick) < 400 and np.bincount(np.r_[i[pick], j[pick]]).max() < 12


def test_spanning_edges_connect_what_all_edges_do():
    random = np.random.default_rng(6)
    for n in (0, 1, 5, 60):
        i, j = random.integers(0, 30, n), random.integers(0, 30, n)
        pick = J.spanning(i, j)
        assert len(pick) <= 30 and all(map(np.array_equal, forest(i, j), forest(i[pick], j[pick])))


@pytest.mark.parametrize("most", [1 << 20, 3])
def test_components(spark, monkeypatch, most):
    monkeypatch.setattr(C, "ONE_TASK", most)
    random = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in random.integers(-60, 60, (70, 2))] + [(i, i + 1) for i in range(100, 140)] + [(None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    root = {x: x for e in edges for x in e if None not in e and e[0] != e[1]}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a is not None and a != b and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    assert got == root
    assert len(forest(np.zeros(0, np.int64), np.zeros(0, np.int64))[0]) == 0


def test_plans_stay_small(spark, sf, monkeypatch):
    joins, real = [], J.table

    def counted(frame, name):
        joins.append(frame._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return real(frame, name)

    monkeypatch.setattr(J, "table", counted)
    J.classes(spark.read.parquet(f"{sf}/documents.parquet"))
    assert max(joins) <= 8  # 28 where lists and components were not tables
