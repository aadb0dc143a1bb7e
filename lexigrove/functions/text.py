"""Text functions as column expressions; Arrow functions where Spark has no expression."""

from __future__ import annotations

import functools
import operator
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

TOKEN = r"[\p{L}\p{N}\p{M}]+|[^\p{Z}\p{C}]"

# Words that are no terms.
STOPWORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves",
    "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself", "they", "them", "their",
    "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "these", "those", "am", "is", "are",
    "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an",
    "the", "and", "but", "if", "or", "because", "as", "until", "while", "of", "at", "by", "for", "with", "about",
    "against", "between", "into", "through", "during", "before", "after", "above", "below", "to", "from", "up",
    "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once", "here", "there", "when",
    "where", "why", "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor",
    "not", "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don", "should",
    "now", "d", "ll", "m", "o", "re", "ve", "y", "ain", "aren", "couldn", "didn", "doesn", "hadn", "hasn", "haven",
    "isn", "ma", "mightn", "mustn", "needn", "shan", "shouldn", "wasn", "weren", "won", "wouldn", "'ll", "'re", "'ve",
    "n't", "'s", "'d", "'m", "''", "``",
)


def tokens(text: Column) -> Column:
    """Runs of letters, digits and marks, and single other visible characters."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


@F.pandas_udf(StringType())
def nfd(text: pd.Series) -> pd.Series:
    """Canonical decomposition (Spark has no expression for it)."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFD", t))


def is_filtered(word: Column) -> Column:
    """Whether a word is punctuation only, or a stopword."""
    return word.rlike(r"^\p{P}+$") | F.lower(word).isin(*STOPWORDS)


def keeps_ngram(flags: Column, mode: str = "any") -> Column:
    """Whether an n-gram stays, from the flags of its words. any, all: if one or all are filtered it goes; ends: if the first or last is."""
    if mode == "any":
        return ~F.exists(flags, lambda f: f)
    if mode == "all":
        return ~F.forall(flags, lambda f: f)
    if mode == "ends":
        return ~(F.element_at(flags, 1) | F.element_at(flags, -1))
    raise ValueError(f"unknown mode: {mode}")


def ngrams(words: Column, n: int = 2, mode: str | None = "any", keep: Callable[[Column], Column] | None = None) -> Column:
    """Lower-case n-grams of 1 to n words, formed before filtering, by start and then length.

    keep: own predicate over the array of a gram's words, instead of mode.
    """
    if mode not in (None, "any", "all", "ends"):
        raise ValueError(f"unknown mode: {mode}")
    marked = F.transform(words, lambda w: F.struct(w.alias("w"), F.lower(w).alias("low"), is_filtered(w).alias("f")))

    def from_starts(all_of: Column) -> Column:
        def at(i: Column) -> Column:
            parts = [F.get(all_of, i + j) for j in range(n)]

            def gram(k: int) -> Column:
                own = parts[:k]
                if keep is not None:
                    kept = keep(F.array(*[p["w"] for p in own]))
                elif mode is not None:
                    flags = [p["f"] for p in ([own[0], own[-1]] if mode == "ends" else own)]
                    kept = ~functools.reduce(operator.and_ if mode == "all" else operator.or_, flags)
                else:
                    kept = F.lit(True)
                text = F.concat(*[x for p in own for x in (F.lit(" "), p["low"])][1:])
                return F.when(kept if k == 1 else (i + k <= F.size(all_of)) & kept, text)

            return F.array(*[gram(k) for k in range(1, n + 1)])

        made = F.flatten(F.transform(F.sequence(F.lit(0), F.size(all_of) - 1), at))
        return F.when(F.size(all_of) > 0, F.filter(made, lambda g: g.isNotNull())).otherwise(F.array().cast("array<string>"))

    return F.get(F.transform(F.array(marked), from_starts), F.lit(0))


def terms(text: Column, n: int = 2, mode: str = "any", tokenizer: Callable[[Column], Column] = tokens) -> Column:
    """Terms of a text for n up to 2 in the common mode without nested arrays; otherwise by ngrams(). tokenizer: what cuts the text into words."""
    if n > 2 or mode != "any":
        return ngrams(tokenizer(text), n, mode)
    marked = F.transform(tokenizer(text), lambda w: F.struct(F.lower(w).alias("w"), is_filtered(w).alias("f")))

    def both(m: Column) -> Column:
        single = F.transform(F.filter(m, lambda x: ~x["f"]), lambda x: x["w"])
        if n == 1:
            return single
        pair = F.zip_with(
            F.slice(m, 1, F.greatest(F.size(m) - 1, F.lit(0))), F.slice(m, 2, F.greatest(F.size(m) - 1, F.lit(0))),
            lambda a, b: F.when(~a["f"] & ~b["f"], F.concat(a["w"], F.lit(" "), b["w"])),
        )
        return F.concat(single, F.filter(pair, lambda x: x.isNotNull()))

    return F.get(F.transform(F.array(marked), both), F.lit(0))


def murmur3(data: bytes | np.ndarray, seed: int = 0) -> np.ndarray:
    """MurmurHash3 (public domain), 32 bits unsigned, of each row of bytes of one length."""
    rows = np.frombuffer(data, np.uint8)[None, :] if isinstance(data, bytes) else data
    n, length = rows.shape
    mask = np.uint64(0xFFFFFFFF)

    def turned(x: np.ndarray, k: int) -> np.ndarray:
        return ((x << np.uint64(k)) | (x >> np.uint64(32 - k))) & mask

    def mixed(k: np.ndarray) -> np.ndarray:
        return turned(k * np.uint64(0xCC9E2D51) & mask, 15) * np.uint64(0x1B873593) & mask

    whole = length // 4 * 4
    blocks = np.ascontiguousarray(rows[:, :whole]).view("<u4").astype(np.uint64)
    h = np.full(n, seed, np.uint64)
    for i in range(whole // 4):
        h = (turned(h ^ mixed(blocks[:, i]), 13) * np.uint64(5) + np.uint64(0xE6546B64)) & mask
    if length > whole:
        tail = np.zeros(n, np.uint64)
        for i in range(length - whole):
            tail |= rows[:, whole + i].astype(np.uint64) << np.uint64(8 * i)
        h ^= mixed(tail)
    h ^= np.uint64(length)
    for factor, shift in ((0x85EBCA6B, 16), (0xC2B2AE35, 13)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor) & mask
    return h ^ (h >> np.uint64(16))


def _hashed(words: list[bytes]) -> np.ndarray:
    """Hashes of words, those of one length together."""
    out = np.zeros(len(words), np.uint64)
    lengths = np.array([len(w) for w in words], np.int64)
    for length in np.unique(lengths):
        own = np.flatnonzero(lengths == length)
        out[own] = murmur3(np.frombuffer(b"".join(words[i] for i in own), np.uint8).reshape(len(own), int(length)))
    return out


def term_bucket(term: Column, size: int = 1 << 24) -> Column:
    """Bucket of a term: seed-0 MurmurHash3 of its UTF-8 bytes, modulo size."""

    @F.pandas_udf("long")
    def bucket(words: pd.Series) -> pd.Series:
        codes, distinct = pd.factorize(words)
        made = pd.Series((_hashed([w.encode() for w in distinct]) % np.uint64(size)).astype(np.int64), dtype="Int64")
        return pd.Series(made.reindex(codes).array) if len(distinct) else pd.Series([pd.NA] * len(words), dtype="Int64")

    return bucket(term)


def normalize_answer(text: Column) -> Column:
    """Lower case, without ASCII punctuation, English articles and superfluous white space."""
    out = F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", "")
    out = F.regexp_replace(out, r"(?U)\b(a|an|the)\b", " ")
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def whitespace_tokens(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")


def _is_punctuation(c: str) -> bool:
    return 33 <= ord(c) <= 47 or 58 <= ord(c) <= 64 or 91 <= ord(c) <= 96 or 123 <= ord(c) <= 126 or unicodedata.category(c)[0] == "P"


# Blocks of CJK ideographs.
CJK = (
    (0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF),
    (0xF900, 0xFAFF), (0x2F800, 0x2FA1F),
)


def basic_words(text: str, lower: bool = True, keep: tuple[str, ...] = ("[UNK]", "[SEP]", "[PAD]", "[CLS]", "[MASK]")) -> list[str]:
    """Words without control characters; ideographs and punctuation apart; without case and accents if lower."""
    shown = []
    for c in text:
        if c in "\t\n\r" or unicodedata.category(c) == "Zs":
            shown.append(" ")
        elif c not in "\0�" and unicodedata.category(c)[0] != "C":
            shown.append(f" {c} " if any(a <= ord(c) <= b for a, b in CJK) else c)
    out: list[str] = []
    for word in "".join(shown).split():
        if word in keep:
            out.append(word)
            continue
        if lower:
            word = "".join(c for c in unicodedata.normalize("NFD", word.lower()) if unicodedata.category(c) != "Mn")
        part = ""
        for c in word:
            if _is_punctuation(c):
                out += [part, c] if part else [c]
                part = ""
            else:
                part += c
        out += [part] if part else []
    return out


def word_pieces(word: str, vocab: dict[str, int], unknown: str = "[UNK]", longest: int = 100) -> list[str]:
    """Longest pieces of the vocabulary from the left; later ones begin with ##."""
    if len(word) > longest:
        return [unknown]
    out, start = [], 0
    while start < len(word):
        for end in range(len(word), start, -1):
            piece = ("##" if start else "") + word[start:end]
            if piece in vocab:
                break
        else:
            return [unknown]
        out.append(piece)
        start = end
    return out


#: Words whose pieces a worker remembers.
REMEMBERED = 1 << 17


def wordpiece_tokens(text: Column, vocab: dict[str, int], lower: bool = True) -> Column:
    """Word pieces of a text; vocab is read in every worker, so pass a vocabulary, not data. Words met before in a task are not cut again."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, list[str]] = {}
        for texts in batches:
            out = []
            for t in texts:
                pieces: list[str] = []
                for w in basic_words(t or "", lower):
                    if w not in known:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known[w] = word_pieces(w, vocab)
                    pieces += known[w]
                out.append(pieces)
            yield pd.Series(out, dtype=object)

    return F.pandas_udf(run, "array<string>")(text)


def projected(piece_text: Column, original: Column, lower: bool = True) -> Column:
    """project_span() for columns."""

    @F.pandas_udf(StringType())
    def run(pieces: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or t is None else project_span(p, t, lower) for p, t in zip(pieces, texts)], dtype=object)

    return run(piece_text, original)


def project_span(piece_text: str, original: str, lower: bool = True) -> str:
    """The part of the original text that a detokenised piece text stands for; the whole original where they don't align."""
    plain = " ".join(basic_words(original, lower))
    at = plain.find(piece_text)
    if at < 0:
        return original
    shown = [i for i, c in enumerate(plain) if c != " "]
    there = [i for i, c in enumerate(original) if c != " "]
    if len(shown) != len(there):
        return original
    place = {p: there[k] for k, p in enumerate(shown)}
    first, last = place.get(at), place.get(at + len(piece_text) - 1)
    return original if first is None or last is None else original[first : last + 1]


def matches_pattern(text: Column, pattern: Column) -> Column:
    """Whether the pattern matches at the text's beginning, without case, over lines; false for patterns that don't compile."""

    @F.pandas_udf("boolean")
    def run(texts: pd.Series, patterns: pd.Series) -> pd.Series:
        import re

        compiled: dict[str, object] = {}
        out = []
        for t, p in zip(texts, patterns):
            if p not in compiled:
                try:
                    compiled[p] = re.compile(p, re.I | re.U | re.M)
                except (re.error, TypeError):
                    compiled[p] = None
            out.append(bool(t is not None and compiled[p] is not None and compiled[p].match(t)))
        return pd.Series(out)

    return run(text, pattern)


def utf8_text(data: Column) -> Column:
    """Text of bytes or text; bytes that are no UTF-8 leave no trace."""
    return F.replace(F.make_valid_utf8(data.cast("string")), F.lit("\ufffd"), F.lit(""))


def untokenized(words: Column, spaces: Column) -> Column:
    """Text of tokens, each with the white space after it, without white space at the end."""
    return F.rtrim(F.array_join(F.zip_with(words, spaces, lambda w, s: F.concat(w, s)), ""))


@F.pandas_udf(ArrayType(IntegerType()))
def running_sums(numbers: pd.Series) -> pd.Series:
    """Of each array the sums of its first one, two, ... numbers."""
    return pd.Series([None if x is None else np.cumsum(x, dtype=np.int32) for x in numbers], dtype=object)


def gaps(text: Column) -> Column:
    """What stands before, between and after the tokens of a text."""
    return F.split(F.coalesce(text, F.lit("")), TOKEN, -1)


def spans(gaps: Column, tokens: Column) -> Column:
    """Array of (text, after, start, end): tokens with the white space and other signs up to the next token, by running sums."""
    from lexigrove.functions.arrays import let

    ends = running_sums(F.zip_with(gaps, tokens, lambda p, w: F.length(p) + F.coalesce(F.length(w), F.lit(0))))

    def of(x: Column) -> Column:
        def span(w: Column, i: Column) -> Column:
            end = F.get(x["e"], i)
            return F.struct(w.alias("text"), F.get(x["p"], i + 1).alias("after"), (end - F.length(w)).alias("start"), end.alias("end"))

        return F.transform(x["w"], span)

    return let(F.struct(gaps.alias("p"), tokens.alias("w"), ends.alias("e")), of)


def token_spans(text: Column) -> Column:
    """spans() of a text."""
    return spans(gaps(text), tokens(text))
