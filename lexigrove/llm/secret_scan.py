"""Secret scan with DataFrame functions only.

Base rules are three patterns (assignments of credentials, access keys, long hex runs).
The method adds spans of high Shannon entropy: over each candidate string a window slides
by one character; the counts of all characters lie in an array of packed integers, of which
only those of the character that leaves and of the one that enters change, and the sum of
c*log2(c), in fixed point, follows by increments. Thresholds depend on the character class, and an
allow-list suppresses placeholders and well-known harmless strings: leading directories in
lower case, UUIDs, runs of one character and placeholders with up to AROUND characters on
either side, within slashes and equal signs. What it names is cut out of the candidate and the
parts between are scored alone. Base spans are never suppressed.

All steps are linear in the text, but for the list of spans, which grows by blocks of BLOCK.
Places are code points, ends exclusive. Null texts count as empty and have no spans.
Each row is scanned alone: ties, repeated rows and further columns have no influence.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the base rules.
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy")

#: Characters of a window, shortest candidate, and bits a character from which a window is suspicious, by class.
WINDOW, SHORTEST, HEX_BITS, MIXED_BITS, LETTER_BITS = 20, 20, 3.0, 3.75, 3.9
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{SHORTEST},}}"
#: Characters on either side that a placeholder covers; spans that are appended to a list together.
AROUND, BLOCK = 16, 64
LEAD = r"^/?(?:[a-z]++/)++"
UUID = r"(?i:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})"
PLACEHOLDER = r"(?i:example|sample|placeholder|changeme|dummy|your[_-]|x{6,}|0123456789|abcdefghij|lorem)"
#: UUIDs, placeholders with what is around them, runs of one character.
ALLOWED = rf"{UUID}|[^/=]{{0,{AROUND}}}{PLACEHOLDER}[^/=]{{0,{AROUND}}}|(.)\1{{7,}}"

#: c*log2(c) for c of a window's characters, and the largest sum of a suspicious window by class, in fixed point.
_UNIT = 1 << 20
TERMS = [round(k * math.log2(k) * _UNIT) if k else 0 for k in range(WINDOW + 1)]
_MOST = {bits: math.floor(WINDOW * (math.log2(WINDOW) - bits) * _UNIT) for bits in (HEX_BITS, MIXED_BITS, LETTER_BITS)}
#: Counts of so many bits lie in one integer; characters begin at this code.
_BITS, _EACH, _FIRST, _WORDS = 5, 12, 32, 8

_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _empty(kind: str) -> Column:
    return F.array().cast(kind)


def _appended(items: Column, start: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """What step(at, item) -> (next at, made) makes of all items in turn, as an array of kind; at begins with start."""

    def inner(acc: Column, x: Column) -> Column:
        at, made = step(acc["at"], x)
        return F.struct(at.alias("at"), F.concat(acc["out"], F.array(made)).alias("out"))

    def outer(all_items: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(all_items) - 1) / BLOCK).cast("int")),
            lambda b: F.slice(all_items, b * BLOCK + 1, BLOCK),
        )

        def block(acc: Column, part: Column) -> Column:
            made = F.aggregate(part, F.struct(acc["at"].alias("at"), _empty(kind).alias("out")), inner)
            return _let(made, lambda m: F.struct(m["at"].alias("at"), F.concat(acc["out"], F.array(m["out"])).alias("out")))

        listed = F.aggregate(blocks, F.struct(start.alias("at"), _empty(f"array<{kind}>").alias("out")), block)
        return F.when(F.size(all_items) > 0, F.flatten(listed["out"])).otherwise(_empty(kind))

    return _let(items, outer)


def _lengths(text: Column, pattern: str, found: Column) -> Column:
    """(before, own) of each match: characters between it and the former one, and its own; a last item for the rest has no own."""
    return F.zip_with(F.split(text, pattern, -1), found, lambda p, m: F.struct(F.length(p).alias("before"), F.length(m).alias("own")))


def _spans(text: Column, pattern: str, found: Column, number: int) -> Column:
    """Starts and ends of all matches: the parts between them and the matches alternate."""

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start, end = at + x["before"], at + x["before"] + x["own"]
        return end, F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end"))

    made = _appended(F.slice(_lengths(text, pattern, found), F.lit(1), F.size(found)), F.lit(0), _SPAN, step)
    return F.when(F.size(found) > 0, made).otherwise(_empty(_SPAN))


def _parts(candidate: Column, start: Column) -> Column:
    """What the allow-list leaves of a candidate: (start, w) of each part."""

    def without_lead(lead: Column) -> Column:
        rest = F.substring(candidate, F.length(lead) + 1, F.length(candidate))

        def cut(c: Column) -> Column:
            matches = F.regexp_extract_all(c, F.lit(ALLOWED), F.lit(0))
            items = F.zip_with(F.split(c, ALLOWED, -1), matches, lambda p, m: F.struct(p.alias("p"), F.coalesce(F.length(m), F.lit(0)).alias("own")))
            step = lambda at, x: (at + F.length(x["p"]) + x["own"], F.struct(at.alias("start"), x["p"].alias("w")))
            return _appended(items, start + F.length(lead), "array<struct<start:int,w:string>>", step)

        return _let(rest, cut)

    return _let(F.regexp_extract(candidate, LEAD, 0), without_lead)


def _bits(word: Column) -> Column:
    """Threshold by character class; null for short parts and those without letters."""
    hexa = word.rlike("^[0-9a-fA-F]+$") & word.rlike("[0-9]") & word.rlike("[a-fA-F]")
    digits = F.length(F.regexp_replace(word, "[^0-9]", ""))
    mixed = word.rlike("[0-9]") & word.rlike("[a-z]") & word.rlike("[A-Z]") | word.rlike("[a-z]{2}|[A-Z]{2}") & (digits >= 4)
    return F.when(
        F.length(word) < SHORTEST, F.lit(None).cast("double"),
    ).when(hexa, F.lit(HEX_BITS)).when(mixed, F.lit(MIXED_BITS)).when(word.rlike("[A-Za-z]"), F.lit(LETTER_BITS))


def _entropy_runs(word: Column, bits: Column) -> Column:
    """Runs of windows over the threshold, as (start, end) within the part."""
    terms = F.array(*[F.lit(t) for t in TERMS])
    most = F.lit(_MOST[LETTER_BITS])
    for b in (HEX_BITS, MIXED_BITS):
        most = F.when(bits == b, F.lit(_MOST[b])).otherwise(most)
    run = "array<struct<start:int,end:int>>"

    ones = F.array(*[F.array(*[F.lit((1 << c % _EACH * _BITS) * (c // _EACH == k)).cast("long") for k in range(_WORDS)]) for c in range(_EACH * _WORDS)])
    nothing = F.array(*[F.lit(0).cast("long") for _ in range(_WORDS)])

    def count(counts: Column, code: Column) -> Column:
        """The packed count of a character."""
        return F.call_function("shiftright", F.get(counts, code["slot"]), code["shift"]).bitwiseAND(F.lit((1 << _BITS) - 1).cast("long")).cast("int")

    def placed(c: Column) -> Column:
        code = F.ascii(c) - _FIRST
        return F.struct(code.alias("code"), F.floor(code / _EACH).cast("int").alias("slot"), (code % _EACH * _BITS).cast("int").alias("shift"))

    def move(own: Column, gone: Column) -> Column:
        change = F.zip_with(F.get(ones, own["code"]), F.coalesce(F.get(ones, gone["code"]), nothing), lambda a, b: a - b)
        return F.struct(
            own.alias("own"), gone.alias("gone"),
            F.coalesce(own["code"] == gone["code"], F.lit(False)).cast("int").alias("same"), change.alias("change"),
        )

    def step(acc: Column, x: Column) -> Column:
        """x: the character that enters, the one that leaves (null: none), whether they are equal, and how the counts change."""
        i = acc["i"] + 1
        gone_count = count(acc["counts"], x["gone"])
        in_count = count(acc["counts"], x["own"]) - x["same"]
        loss = F.when(x["gone"].isNotNull(), F.get(terms, gone_count) - F.get(terms, gone_count - 1)).otherwise(0)
        total = acc["total"] - loss + F.get(terms, in_count + 1) - F.get(terms, in_count)
        counts = F.zip_with(acc["counts"], x["change"], lambda a, b: a + b)

        def moved(total: Column) -> Column:
            hot = (i >= WINDOW) & (total <= most)
            joins = acc["end"] >= i - WINDOW
            closes = hot & ~joins & (acc["end"] > 0)
            return F.struct(
                i.alias("i"), total.alias("total"), counts.alias("counts"),
                F.when(hot & ~joins, i - WINDOW).otherwise(acc["start"]).alias("start"), F.when(hot, i).otherwise(acc["end"]).alias("end"),
                F.when(closes, F.concat(acc["runs"], F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end"))))).otherwise(acc["runs"]).alias("runs"),
            )

        return _let(total, moved)

    def slid(codes: Column) -> Column:
        gone = F.concat(F.array_repeat(F.lit(None).cast("struct<code:int,slot:int,shift:int>"), WINDOW), codes)
        moves = F.slice(F.zip_with(codes, gone, move), F.lit(1), F.size(codes))
        start = F.struct(
            F.lit(0).alias("i"), F.lit(0).alias("total"), F.array_repeat(F.lit(0).cast("long"), _WORDS).alias("counts"), F.lit(-1).alias("start"), F.lit(-1).alias("end"), _empty(run).alias("runs")
        )
        last = lambda r: F.when(r["end"] > 0, F.concat(r["runs"], F.array(F.struct(r["start"].alias("start"), r["end"].alias("end"))))).otherwise(r["runs"])
        return _let(F.aggregate(moves, start, step), last)

    return _let(F.transform(F.filter(F.split(word, ""), lambda c: c != ""), placed), slid)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Id, text, the columns in keep, and found: array of (start, kind, end) with kind as the place in KINDS."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), F.struct(F.lit(0).alias("_0"), *[F.col(c) for c in keep]).alias("_keep"))
    out = out.select(
        "*",
        F.regexp_extract_all("_text", F.lit(ASSIGN), F.lit(0)).alias("_a"),
        F.regexp_extract_all("_text", F.lit(ACCESS), F.lit(0)).alias("_k"),
        F.regexp_extract_all("_text", F.lit(HEX), F.lit(0)).alias("_h"),
        F.regexp_extract_all("_text", F.lit(CANDIDATE), F.lit(0)).alias("_c"),
    )
    text = F.col("_text")
    none = _empty(_SPAN)
    value = F.regexp_extract_all("_text", F.lit(ASSIGN), F.lit(2))
    assign = F.filter(
        F.zip_with(_spans(text, ASSIGN, F.col("_a"), 0), value, lambda s, v: F.struct(s.alias("s"), F.length(v).alias("n"))),
        lambda x: x["n"] >= 8,
    )
    assign = F.when(F.size("_a") > 0, F.transform(assign, lambda x: x["s"])).otherwise(none)

    def scored(part: Column) -> Column:
        def of_class(bits: Column) -> Column:
            made = F.transform(
                _entropy_runs(part["w"], bits), lambda r: F.struct((part["start"] + r["start"]).alias("start"), F.lit(3).alias("kind"), (part["start"] + r["end"]).alias("end"))
            )
            return F.when(bits.isNotNull(), made).otherwise(none)

        return _let(_bits(part["w"]), of_class)

    placed = F.flatten(F.zip_with(_spans(text, CANDIDATE, F.col("_c"), 3), F.col("_c"), lambda s, c: _parts(c, s["start"])))
    entropy = F.when(F.size("_c") > 0, F.flatten(F.transform(placed, scored))).otherwise(none)
    spans = F.concat(assign, _spans(text, ACCESS, F.col("_k"), 1), _spans(text, HEX, F.col("_h"), 2), entropy)
    return out.select(
        F.col("_id").alias(id_col), F.col("_text").alias(text_col), *[F.col(f"_keep.{c}").alias(c) for c in keep],
        F.array_sort(spans).alias("found"),
    )


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, a digest of the base spans, and all spans as text."""
    found = scan(docs, id_col, text_col)
    base = F.filter("found", lambda s: s["kind"] < 3)

    def of_kind(k: int) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    count = [of_kind(k) for k in range(4)]
    return found.select(id_col, *count, F.sha2(_written(base).cast("binary"), 256).alias("base_sha256"), _written(F.col("found")).alias("spans"))


def _clean(text: Column, found: Column, mark: str) -> Column:
    """The text with the mark for each run of overlapping spans. A block of runs is cut out of the text first, so that long texts aren't gone through for each run."""

    def merged(at: Column, s: Column) -> tuple[Column, Column]:
        return F.greatest(at, s["end"]), F.struct(F.when(s["start"] >= at, s["start"]).alias("start"), F.greatest(at, s["end"]).alias("end"))

    def runs_of(steps: Column) -> Column:
        """Each run's start with the last end before the next run's start."""
        opens = F.filter(F.transform(steps, lambda x, i: F.struct(x["start"].alias("start"), i.alias("i"))), lambda x: x["start"].isNotNull())

        def closed(o: Column) -> Column:
            after = F.concat(F.slice(F.transform(o, lambda x: x["i"]), F.lit(2), F.size(o)), F.array(F.size(steps)))
            return F.zip_with(o, after, lambda x, j: F.struct(x["start"].alias("start"), F.get(steps, j - 1)["end"].alias("end")))

        return _let(opens, closed)

    def rebuilt(runs: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(runs) - 1) / BLOCK).cast("int"))

        def block(b: Column) -> Column:
            own = F.slice(runs, b * BLOCK + 1, BLOCK)
            low = F.when(b == 0, F.lit(0)).otherwise(F.get(runs, b * BLOCK - 1)["end"])
            high = F.get(runs, F.least(F.size(runs), (b + 1) * BLOCK) - 1)["end"]
            part = F.substring(text, low + 1, high - low)

            def within(p: Column) -> Column:
                step = lambda at, r: (r["end"], F.concat(F.substring(p, at - low + 1, r["start"] - at), F.lit(mark)))
                return F.array_join(_appended(own, low, "array<string>", step), "")

            return _let(part, within)

        tail = F.get(runs, F.size(runs) - 1)["end"]
        return F.concat(F.array_join(F.transform(blocks, block), ""), F.substring(text, tail + 1, F.length(text)))

    steps = _appended(found, F.lit(0), "array<struct<start:int,end:int>>", merged)
    return F.when(F.size(found) == 0, text).otherwise(_let(_let(steps, runs_of), rebuilt))


def redact(docs: DataFrame, mark: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same columns; each run of overlapping or touching spans in the text is replaced by one mark or more, one for each span that begins where no other is open. Null texts stay null."""
    names = docs.columns
    others = tuple(c for c in names if c not in (id_col, text_col))
    was = docs.select("*", F.col(text_col).isNull().alias("_null"))
    found = scan(was, id_col, text_col, (*others, "_null"))
    return found.withColumn(text_col, F.when(~F.col("_null"), _clean(F.col(text_col), F.col("found"), mark))).select(*names)
