"""Scalar expressions on numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(c: Column | str, digits: int) -> Column:
    """Rounded so that half-way cases go up whatever order the terms of a sum were added in; zero has no sign."""
    r = F.round((F.col(c) if isinstance(c, str) else c) + 10.0 ** -(digits + 3), digits)
    return F.when(r == 0, 0.0).otherwise(r)


def close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """Equal within a relative and an absolute tolerance; two missing values are equal, infinities only if the same."""
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).when(F.isnan(a) | F.isnan(b), F.isnan(a) & F.isnan(b)).otherwise((a == b) | (F.abs(a - b) <= atol + rtol * F.abs(b)))


def bit(word: Column, place: int) -> Column:
    return F.shiftright(word, place).bitwiseAND(1)


def milliseconds(seconds: Column) -> Column:
    return F.concat(F.rint(seconds * 1000).cast("int").cast("string"), F.lit("ms"))


def odds(p: Column) -> Column:
    return F.ln(p / (1 - p))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
