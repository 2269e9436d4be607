"""Rounding, clamping and vectors as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def let(value: Column, fn) -> Column:
    """``fn`` of a value that is computed once: a lambda would compute an expression anew for every element."""
    return F.transform(F.array(value), fn)[0]


def truthy_or(a, b) -> Column:
    """``a`` unless it is null or zero: zero counts as missing."""
    return F.when(col(a).isNotNull() & (col(a) != 0), col(a)).otherwise(col(b) if isinstance(b, (str, Column)) else F.lit(b))


def clamp(c, low, high, default=None) -> Column:
    value = F.coalesce(col(c), F.lit(default)) if default is not None else col(c)
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def clamp_int(c, low: int, high: int, default: int) -> Column:
    """A lenient integer: the default where it can't be read."""
    return clamp(F.expr(f"try_cast({c} AS INT)") if isinstance(c, str) else c.try_cast("int"), low, high, default)


def dot(a, b) -> Column:
    pairs = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a, b) -> Column:
    """Cosine similarity in double precision; 0 for a zero vector."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def l2_normalize(a) -> Column:
    n = F.when(norm(a) > 0, norm(a)).otherwise(F.lit(1.0))
    return F.transform(col(a), lambda x: x.cast("double") / n)


def sign_hash(a, bits: int = 64) -> Column:
    """The signs of the first ``bits`` components as one long."""
    out = F.lit(0).cast("long")
    for i in range(bits):
        out = out.bitwiseOR(F.when(F.try_element_at(col(a), F.lit(i + 1)) > 0, F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return out


def hamming(a, b) -> Column:
    return F.bit_count(col(a).bitwiseXOR(col(b)))


def mean_abs_diff(a, b) -> Column:
    d = F.zip_with(col(a), col(b), lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    return F.aggregate(d, F.lit(0.0), lambda s, x: s + x) / F.size(d)


def even_indices(n, limit: int) -> Column:
    """Indices of ``limit`` evenly spaced items of ``n``: all when they fit, the middle for one."""
    n = col(n).cast("long")
    every = F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))
    if limit <= 0:
        return F.array().cast("array<bigint>")
    if limit == 1:
        return F.when(n <= 1, every).otherwise(F.array(F.floor(n / 2)))
    step = (n - 1) / F.lit(float(limit - 1))
    spaced = F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda i: F.least(n - 1, F.bround(i * step).cast("long")))
    return F.when(n <= limit, every).otherwise(F.array_sort(F.array_distinct(spaced)))
