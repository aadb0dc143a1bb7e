"""The pipeline stage by stage against brute force, BPE and packing against the library."""

import random
import re
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from lexigrove.llm import bpe, packing, secret_scan, toxicity
from lexigrove.llm.queries import tokenizer_path

from .test_jaccard_join import brute as components_of
from .test_jaccard_join import thue_morse
from .test_native import base, runs
from .test_suffix_dedup import brute as repeats_of


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def entropy_spans(text):
    out = []
    for m in re.finditer(secret_scan.CANDIDATE, text):
        w = m[0]
        if re.search(secret_scan.ALLOWED, w):
            continue
        has = [bool(re.search(p, w)) for p in ("[0-9]", "[a-z]", "[A-Z]", "[a-fA-F]", "[a-z]{2}|[A-Z]{2}")]
        if re.fullmatch("[0-9a-fA-F]+", w) and has[0] and has[3]:
            bits = secret_scan.HEX_BITS
        elif all(has[:3]) or has[0] and has[4] and len(re.sub("[^0-9]", "", w)) >= 4:
            bits = secret_scan.MIXED_BITS
        else:
            continue
        out += [(m.start() + a, 3, m.start() + b) for a, b in runs(w, bits)]
    return out


def redacted(text):
    out, at = "", 0
    for a, _, b in sorted(base(text) + entropy_spans(text)):
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:]


def test_stages_equal_brute_force(spark, sf, library):
    first = spark.read.parquet(f"{sf}/documents.parquet")
    planted = [
        (9001, "key token=abcdefgh12345 and more words follow here " + "q8Zr2LmN0pXw7Tb4Vk9Yc1Hd6Gj3Fs5", "en", "s", 1),
        (9002, None, "en", "s", 0), (9003, "", None, None, None),
    ]
    docs = first.unionAll(spark.createDataFrame(planted, first.schema)).cache()
    names = docs.columns
    state = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in P.STAGES[:-1]:
        before = docs
        docs = stage(spark, before, sf)
        assert docs.columns == names
        docs = P.table(docs, name)
        got = {r.doc_id: r.text for r in docs.collect()}
        assert all(r.n_chars == len(r.text) for r in docs.collect() if r.text is not None and name != "toxicity" and r.doc_id < 9000)
        keys = sorted(state)
        if name == "toxicity":
            labels = spark.read.parquet(f"{sf}/labels.parquet").filter(~toxicity.held_out(F.col("doc_id")))
            scores = toxicity.score(before, toxicity.fit(before, labels), keep=("doc_id",)).collect()
            assert {r.doc_id for r in scores if r.score < P.TOXIC} == set(got)
            state = {k: v for k, v in state.items() if k in got}
        elif name == "ngram_jaccard_join":
            state = {i: state[i] for i, _, c in components_of([(k, state[k]) for k in keys]) if i == c}
        elif name == "suffix_array_dedup":
            want = repeats_of([state[k] for k in keys], 400)
            for k, w in zip(keys, want):
                if state[k] is not None:
                    assert len(got[k].encode()) <= w[0] - w[1] <= len(got[k].encode()) + 6 * w[2]
                    state[k] = got[k]
        else:
            state = {k: None if v is None else redacted(v) for k, v in state.items()}
        assert got == state
    pieces = defaultdict(list)
    for r in P.STAGES[-1][1](spark, docs, sf).collect():
        pieces[r.doc_id].append(r)
    assert set(pieces) == set(state)
    for k, own in pieces.items():
        ids = library.encode(state[k] or "", add_special_tokens=False).ids + [0]
        own.sort(key=lambda r: r.start)
        assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1].tolist()] and own[-1].start + own[-1].length == len(ids)
        for r in own:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())


def test_bpe_equals_the_library(library):
    own = bpe.encoder(tokenizer_path())
    r = random.Random(1)
    parts = [*"aaabst'  \n\t.!=12é日\x1c\x85\x00　\xa0", "'s", "'re", "'ll", "<|endoftext|>", "aaaaaaa", "́", "Ⅷ", "😀", "ſ", "    "]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(30))) for _ in range(3000)] + ["", "=" * 5000, "ab" * 20_000]
    first, second = thue_morse()
    texts += [f"{first} {second}", f"{second} {first}", first, second]
    words, at = own.words_of(texts)
    for i, e in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        ids = own.ids(words[at[i] : at[i + 1]]).tolist()
        assert ids == e.ids and own.decode(ids) == library.decode(e.ids, skip_special_tokens=False) == texts[i]


def test_round_trip_of_rows(spark, monkeypatch):
    rows = [(1, "one  two"), (1, "one  two"), (None, None), (2, ""), (3, "x" * 100_000 + " é<|endoftext|>")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_tokens int")
    got = bpe.encode_decode(docs, tokenizer_path(), keep_ids=True).collect()
    assert Counter((r.doc_id, r.decoded) for r in got) == Counter((i, t or "") for i, t in rows)
    assert all(len(r.ids) == r.n_tokens for r in got)
    assert bpe.encode_decode(docs.limit(0), tokenizer_path()).count() == 0


def test_best_fit_decreasing_fills_windows():
    r = random.Random(3)
    for n in (0, 1, 5, 300):
        lengths = [r.randrange(1, 65) for _ in range(n)]
        windows = packing.best_fit_decreasing(lengths, 64)
        cover = defaultdict(list)
        for w in windows:
            assert 0 < sum(k for _, _, k in w) <= 64
            for piece, start, k in w:
                cover[piece].append((start, k))
        assert sum(sum(k for _, _, k in w) < 64 for w in windows) <= 1
        for i, length in enumerate(lengths):
            at = 0
            for start, k in sorted(cover[i]):
                assert start == at and k > 0
                at += k
            assert at == length


def test_packing_of_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_TOKENS", 300)
    rows = [(i % 7 or None, "w " * (i * 13 % 97)) for i in range(60)] + [(100, None), (101, "y " * 5000)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, offset int").repartition(3)
    got = packing.pack(docs, tokenizer_path(), size=64, keep_ids=True).collect()
    sequences = defaultdict(list)
    for r in got:
        assert r.length == len(r.ids)
        sequences[r.sequence_id].append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert sum(r.start == 0 for r in got) == len(rows)
    assert packing.pack(docs.limit(0), tokenizer_path()).count() == 0


def test_a_worker_that_has_packed_holds_no_words(monkeypatch, spark):
    made = []
    monkeypatch.setattr(packing, "arrow", lambda frame, run, schema: made.append(run) or frame)
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    packing.pack(spark.createDataFrame([(1, "a")], "doc_id long, text string"), tokenizer_path())
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["some words to learn", None])], ["id", "text"])
    assert [sum(b.num_rows for b in made[0](iter([batch]))) for _ in range(2)] == [2, 2]
    own = bpe.encoder(tokenizer_path())
    assert own.words == len(own.index) == len(own.long) == 0 and own.encode("some words") == own.encode("some words")
