"""Cells of several levels as one key, in which a missing level is a level like any other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KEY = "__cell"


def cell_key(keys: Sequence[str]) -> Column:
    """The levels as a struct: unlike the columns themselves, it equals itself where levels are null."""
    return F.struct(*keys) if keys else F.lit(0)


def join_cells(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """left joined to right (inner, left, left_semi or left_anti) on all keys, null levels matching each other; keys come once, from left."""
    other = right.withColumn(_KEY, cell_key(keys)).drop(*keys)
    return left.withColumn(_KEY, cell_key(keys)).join(other, _KEY, how).drop(_KEY)


def cell_label(keys: Sequence[str]) -> Column:
    """The levels as text that differs wherever they do: each behind its length, and a dash for a missing one."""
    text = [F.col(k).cast("string") for k in keys]
    return F.concat_ws("|", *(F.when(t.isNull(), "-").otherwise(F.concat(F.char_length(t).cast("string"), F.lit(":"), t)) for t in text))
