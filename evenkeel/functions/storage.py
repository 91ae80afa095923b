"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL = threading.local()


def shared_folder(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir``; where it is unset, a new one on a local master, and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="evenkeel-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _scratches() -> list[list[str]]:
    if not hasattr(_LOCAL, "scratches"):
        _LOCAL.scratches = []
    return _LOCAL.scratches


def _written(df: DataFrame, scratches: list[list[str]]) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/evenkeel-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if scratches:
        scratches[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame) -> DataFrame:
    """Cuts the lineage: writes df as Parquet into the shared folder and returns the table read back. Within ``scratch`` it goes at the block's end."""
    return _written(df, _scratches())


def kept(df: DataFrame) -> DataFrame:
    """As ``materialize``, but the table outlives the ``scratch`` block around it."""
    return _written(df, _scratches()[:-1])


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder of any file system that Spark knows."""
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    file.getFileSystem(spark._jsc.hadoopConfiguration()).delete(file, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that the block materializes when it ends; what is used later must be ``kept``."""
    _scratches().append([])
    try:
        yield
    finally:
        for path in _scratches().pop():
            remove(spark, path)
