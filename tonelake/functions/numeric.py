"""Numeric expressions with defined results for null, NaN and infinite values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_finite(c: Column) -> Column:
    """True for a finite number, false for null, NaN and infinities."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def finite(c: Column) -> Column:
    """The value where finite, else null."""
    return F.when(is_finite(c), c)


def clamp(c: Column, low: float, high: float) -> Column:
    """Null stays null (greatest and least would skip it)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def decibels(c: Column) -> Column:
    return 20 * F.log10(F.greatest(c, F.lit(1e-12)))


def parse_double(c: Column, default: float | None = None) -> Column:
    """Text as a finite double; the default (null) where it is none."""
    x = finite(c.try_cast("double"))
    return x if default is None else F.coalesce(x, F.lit(float(default)))


def bound(value: Column, f) -> Column:
    """f(value) with the value computed once: inside a lambda over an array, a plain expression would be computed per element."""
    return F.element_at(F.transform(F.array(value), f), 1)
