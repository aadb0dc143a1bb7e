"""Suffix dedup against brute force."""

import hashlib
import random
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrove.llm import suffix_dedup as S
from lexigrove.llm.shared import table


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        cover = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                cover[i : i + length] = True
        kept = bytes(b for b, c in zip(r, cover) if not c)
        edge = np.r_[False, cover, False]
        out.append((len(r), int(cover.sum()), int((edge[1:] & ~edge[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    r = random.Random(seed)
    words = ["ab", "é", "the ", "x", "aaaa", "日本", "\n", "zq"]
    base = ["".join(r.choice(words) for _ in range(r.randrange(60))) for _ in range(12)]
    texts = [None, "", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", base[0], base[0]]
    for _ in range(25):
        texts.append("".join(r.choice(base)[r.randrange(9) :] + r.choice(words) for _ in range(r.randrange(1, 4))))
    return texts


@pytest.mark.parametrize("length,gram,most,size", [(12, 4, 1000, 1 << 20), (12, 4, 2, 64), (24, 16, 1000, 100), (20, 12, 3, 1 << 20)])
def test_equals_brute_force(spark, monkeypatch, length, gram, most, size):
    monkeypatch.setattr(S, "PASS_BYTES", size)
    monkeypatch.setattr(S, "BATCH_PIECES", 5)
    texts = corpus(length + most)
    docs = spark.createDataFrame([(None if i == 3 else i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, k1 int").repartition(3)
    got = {(r.row.doc_id if r.row.doc_id is not None else 3): tuple(r)[1:5] for r in S.dedup(docs, length, gram, most).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, length)


def test_production_length_on_a_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.unionAll(docs.limit(2))
    rows = docs.collect()
    want = sorted(zip([r.doc_id for r in rows], brute([r.text for r in rows], S.LENGTH)))
    got = sorted((r.doc_id, tuple(r)[1:]) for r in S.report(docs.withColumn("row", F.lit(1))).collect())
    assert got == want and any(w[1][1] for w in want)


def test_texts_keep_their_columns(spark):
    same = "word and more " * 40
    docs = spark.createDataFrame([(1, "one " + same, "s"), (2, "two " + same, None), (3, None, "x")], "doc_id long, text string, kept string")
    got = sorted(map(tuple, S.without_repeats(docs).collect()))
    assert [g[0::2] for g in got] == [(1, "s"), (2, None), (3, "x")] and got[2][1] is None and len(got[0][1]) < 20
    assert S.report(docs.limit(0)).count() == 0


def test_row_comes_back_and_only_spans_stay(spark):
    same = "word and more " * 40
    rows = [(1, "one " + same), (2, "two " + same), (3, None), (4, "")]
    keyed = S._keyed(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    assert {r.row.text for r in keyed.collect()} == {None, ""}  # shuffled once, as text
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = {p.name for p in folder.iterdir()}
    got = S.dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(tuple(r.row) for r in got.collect()) == rows
    assert [p.name.split("-")[0] for p in folder.iterdir() if p.name not in before] == ["spans"]


def test_tables_leave_no_shuffle_files(spark):
    folder = Path(spark.sparkContext.getConf().get("spark.local.dir", "/tmp"))
    files = lambda: {str(p) for p in folder.glob("blockmgr-*/*/shuffle_*")}
    before = files()
    table(spark.range(1000).repartition(3, "id"), "dealt")
    for _ in range(50):  # files go in the background
        if not (left := {f for f in files() - before if f.endswith(".data")}):
            break
        time.sleep(0.1)
    assert not left and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
