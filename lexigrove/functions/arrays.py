"""Sequential work on arrays as column expressions, linear in the array."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Items that are appended to a list together: the list of blocks is copied once for each block, not for each item.
BLOCK = 64


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once for each row, wherever use puts it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def empty(kind: str) -> Column:
    return F.array().cast(kind)


def scanned(items: Column, start: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """What step(state, item) -> (next state, made) makes of all items in turn, as an array of type kind; the state begins with start."""

    def inner(acc: Column, x: Column) -> Column:
        state, made = step(acc["at"], x)
        return F.struct(state.alias("at"), F.concat(acc["out"], F.array(made)).alias("out"))

    def outer(all_items: Column) -> Column:
        last = F.floor((F.size(all_items) - 1) / BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(all_items, b * BLOCK + 1, BLOCK))

        def block(acc: Column, part: Column) -> Column:
            made = F.aggregate(part, F.struct(acc["at"].alias("at"), empty(kind).alias("out")), inner)
            return let(made, lambda m: F.struct(m["at"].alias("at"), F.concat(acc["out"], F.array(m["out"])).alias("out")))

        listed = F.aggregate(blocks, F.struct(start.alias("at"), empty(f"array<{kind}>").alias("out")), block)
        return F.when(F.size(all_items) > 0, F.flatten(listed["out"])).otherwise(empty(kind))

    return let(items, outer)
