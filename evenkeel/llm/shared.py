"""Helpers shared by the corpus operators: bound lambdas, joins on hot keys, and the storage and ranks of the core."""

from __future__ import annotations

import io
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.functions.ranks import BROADCAST_ROWS, gapless_rank
from evenkeel.functions.storage import kept, materialize, remove, scratch, shared_folder

__all__ = ["BROADCAST_ROWS", "bind", "by_place", "gapless_rank", "join_split", "kept", "kept_arrays", "materialize", "remove", "scratch", "shared_folder"]

#: Most keys that count as hot: each of them holds more than this part of all rows.
HOT_KEYS = 10_000


def join_split(rows: DataFrame, keys: DataFrame, key: str, size: str) -> DataFrame:
    """rows joined to keys, which has one row a key, with the rows of a hot key left where they are.

    ``size`` is a column of keys: how many of rows bear the key. Keys of over one HOT_KEYS-th of the
    sizes' sum, fewer than HOT_KEYS by that rule, are broadcast; only the rows of others are shuffled.
    rows is read twice.
    """
    keys = materialize(keys)
    total = keys.agg(F.sum(size)).first()[0] or 0
    is_hot = F.col(size) > total / HOT_KEYS
    hot = F.broadcast(keys.where(is_hot))
    rest = rows.join(hot, key, "left_anti").join(keys.where(~is_hot), key)
    return rows.join(hot, key).unionByName(rest)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row instead of at each place where body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def by_place(df: DataFrame) -> DataFrame:
    """df with plain column names, for workers that take columns by their place: names with dots or backticks don't reach mapInArrow."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def kept_arrays(spark: SparkSession, name: str, make: Callable[[], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """The arrays that make() returns, kept in the shared folder under a name that must change with all that they depend on.

    A later session that has the same folder reads them instead. Of sessions that make them at once, one keeps its own.
    """
    hadoop, path = spark._jvm.org.apache.hadoop.fs, f"{shared_folder(spark)}/evenkeel-model-{name}"
    system = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(hadoop.Path(path)):
        with np.load(io.BytesIO(bytes(spark.read.parquet(path).first()["arrays"]))) as found:
            return dict(found)
    made, file = make(), io.BytesIO()
    np.savez(file, **made)
    own = f"{path}-{uuid.uuid4().hex}"
    spark.createDataFrame([(bytearray(file.getvalue()),)], "arrays binary").coalesce(1).write.parquet(own)
    if system.exists(hadoop.Path(path)) or not system.rename(hadoop.Path(own), hadoop.Path(path)):
        remove(spark, own)
    return made
