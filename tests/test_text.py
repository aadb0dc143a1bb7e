"""Text and vector functions against hand-computed values."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexigrove.functions import text as X
from lexigrove.functions import vector as V


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column).first()[0]


def test_tokens_and_terms(spark):
    assert one(spark, X.tokens(F.col("x")), "Café-au lait, 3$") == ["Café", "-", "au", "lait", ",", "3", "$"]
    assert one(spark, X.tokens(F.col("x")), None) == []
    got = one(spark, X.terms(F.col("x")), "The red fox and dogs run. Fast fox")
    assert sorted(got) == sorted(["red", "fox", "dogs", "run", "fast", "fox", "red fox", "dogs run", "fast fox"])
    assert got and sorted(one(spark, X.ngrams(X.tokens(F.col("x"))), "The red fox and dogs run. Fast fox")) == sorted(got)


@pytest.mark.parametrize("mode,want", [("any", ["cell", "wall"]), ("all", ["cell", "cell the", "cell the wall", "the wall", "wall"]), ("ends", ["cell", "cell the wall", "wall"])])
def test_ngram_modes(spark, mode, want):
    assert sorted(one(spark, X.ngrams(X.tokens(F.col("x")), 3, mode), "cell the wall")) == want
    with pytest.raises(ValueError):
        X.keeps_ngram(F.array(), "none")


def test_own_predicate(spark):
    assert one(spark, X.ngrams(X.tokens(F.col("x")), 1, keep=lambda g: g[0] != "b"), "a b c") == ["a", "c"]


def test_hash_and_normal_forms(spark):
    assert [int(X.murmur3(w)[0]) for w in (b"", b"hello", b"abcd")] == [0, 0x248BFA47, X.murmur3(b"abcd")[0]] and X.murmur3(b"abcd")[0] % (1 << 24) == 15558506
    assert spark.createDataFrame([("abcd",), (None,)], "x string").select(X.term_bucket(F.col("x"))).collect()[0][0] == 15558506
    assert one(spark, X.nfd(F.col("x")), "\u00e9") == "e\u0301"
    assert one(spark, X.normalize_answer(F.col("x")), "The  an-swer, A (b)!") == "answer b"
    assert one(spark, X.normalize_answer(F.col("x")), "the-an") == "thean"


def test_word_pieces(spark):
    vocab = {t: i for i, t in enumerate(["[UNK]", "un", "##aff", "##able", "!", "日", "resume"])}
    column = X.wordpiece_tokens(F.col("x"), vocab)
    assert one(spark, column, "Unaffable! 日x Résumé") == ["un", "##aff", "##able", "!", "日", "[UNK]", "resume"]
    assert X.word_pieces("a" * 101, {"a": 0}) == ["[UNK]"]
    assert X.basic_words("[MASK] a\0b​") == ["[MASK]", "ab"]
    assert X.project_span("smith", "Steve Smith's") == "Smith" and X.project_span("zzz", "Steve") == "Steve"


def test_patterns(spark):
    frame = spark.createDataFrame([("Abc", "a.c"), ("xabc", "abc"), ("a", "("), (None, "a")], "t string, p string")
    assert [r[0] for r in frame.select(X.matches_pattern(F.col("t"), F.col("p"))).collect()] == [True, False, False, False]


def test_quantisation_rounds_half_to_even_and_clips(spark):
    values = [-9.0, -2.0, -1.975, -1.925, 0.0, 4.35, 5.0]
    want = [int(np.round(np.clip((v + 2) * 20, -128, 127))) for v in values]
    assert list(one(spark, V.quantize(F.col("x")), values, "array<double>")) == want
    back = one(spark, V.dequantize(V.quantize(F.col("x"))), values, "array<double>")
    assert max(abs(a - b) for a, b in zip(back[1:6], values[1:6])) <= 0.025 + 1e-9
    assert one(spark, V.dequantize(F.col("x"), 1.6, 80, keep_zeros=True), [-128, 0], "array<tinyint>") == [0.0, 1.6]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(-2, 2), min_size=3, max_size=3), st.lists(st.floats(-2, 2), min_size=3, max_size=3))
def test_l2_of_augmented_vectors_gives_inner_products(spark, x, q):
    most = 4.0
    longer = one(spark, V.augment(F.col("x"), most, 2), x, "array<double>")
    assert len(longer) == 6 and math.isclose(longer[0] ** 2, most**2 - sum(v * v for v in x), abs_tol=1e-9)
    l2 = sum((a - b) ** 2 for a, b in zip(longer, [0.0, *q, 0.0, 0.0]))
    qn = math.sqrt(sum(v * v for v in q))
    got = one(spark, V.l2_to_ip(F.col("x"), F.lit(qn), F.lit(most)), l2, "double")
    assert math.isclose(got, sum(a * b for a, b in zip(x, q)), abs_tol=1e-9)
