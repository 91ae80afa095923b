"""Number predicates that treat missing, NaN and infinite values alike under ANSI SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(c: Column) -> Column:
    """c as a double; text that is no number, and NaN, become null."""
    return F.nanvl(c.try_cast("double"), F.lit(None).cast("double"))


def finite(c: Column) -> Column:
    return F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def integer_like(c: Column) -> Column:
    return finite(c) & F.coalesce(F.abs(c - F.rint(c)) <= 1e-9, F.lit(False))


def sure(c: Column) -> Column:
    """A flag that is never null."""
    return F.coalesce(c, F.lit(False))


def all_of(*flags: Column) -> Column:
    return reduce(lambda a, b: a & b, flags)


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, null unless whole is positive."""
    return F.when(whole > 0, 100 * part / whole)
