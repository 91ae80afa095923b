"""Outcome classes on a stream: the batch expressions are stateless, so they serve as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evenkeel.operators.outcomes import derive_outcomes
from evenkeel.sources.files import RUN_SCHEMA


def run_stream(spark: SparkSession, path: str, schema: str = RUN_SCHEMA) -> DataFrame:
    """New run files of a folder as they come."""
    return spark.readStream.schema(schema).parquet(path)


def outcome_stream(runs: DataFrame, **columns: str) -> DataFrame:
    return derive_outcomes(runs, **columns)
