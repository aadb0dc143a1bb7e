"""Vector arithmetic as column expressions over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def quantize(a: Column, offset: float = -2.0, scale: float = 20.0) -> Column:
    """Bytes: (x - offset) * scale, within a byte, rounded half to even."""
    return F.transform(a, lambda x: F.rint(F.least(F.greatest((x.cast("double") - offset) * scale, F.lit(-128.0)), F.lit(127.0))).cast("tinyint"))


def dequantize(a: Column, offset: float = -2.0, scale: float = 20.0, keep_zeros: bool = False) -> Column:
    """x / scale + offset; with keep_zeros, bytes that stand for nothing (-128) give 0."""
    value = lambda x: x.cast("double") / scale + offset
    return F.transform(a, lambda x: F.when(x == -128, F.lit(0.0)).otherwise(value(x)) if keep_zeros else value(x))


def augment(a: Column, most: Column | float, zeros: int = 0) -> Column:
    """The vector after sqrt(most^2 - |a|^2), so that L2 order is inner product order; zeros more at the end."""
    most = F.lit(most) if isinstance(most, float) else most
    first = F.sqrt(F.greatest(F.lit(0.0), most * most - norm(a) * norm(a)))
    return F.concat(F.array(first), F.transform(a, lambda x: x.cast("double")), F.array_repeat(F.lit(0.0), zeros))


def l2_to_ip(distance2: Column, query_norm: Column | None = None, most: Column | None = None) -> Column:
    """Inner product from a squared L2 distance between augmented vectors."""
    if most is None or query_norm is None:
        return -0.5 * distance2
    return -0.5 * (distance2 - query_norm * query_norm - most * most)
