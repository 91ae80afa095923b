"""Checks that return their violations as rows, and a helper that raises on any."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_none(violations: DataFrame, what: str) -> None:
    """Raises with a few examples if there is any row."""
    if rows := violations.limit(5).collect():
        raise ValueError(f"{what}: {[r.asDict() for r in rows]}")


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def expectations(observed: DataFrame, expected: Mapping[str, object]) -> DataFrame:
    """(check, expected, observed, ok) from a one-row table of totals."""
    rows = F.array(*(F.struct(F.lit(k).alias("check"), F.lit(float(v)).alias("expected"), F.col(k).cast("double").alias("observed")) for k, v in expected.items()))
    return observed.select(F.explode(rows).alias("r")).select("r.*").withColumn("ok", F.coalesce(F.col("expected") == F.col("observed"), F.lit(False)))


def not_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows != 1")


def reconcile(df: DataFrame, total: Column, parts: Sequence[Column]) -> DataFrame:
    """Rows whose parts do not add up to their total."""
    return df.filter(F.coalesce(sum(parts[1:], parts[0]) != total, F.lit(True)))


def schedule_violations(schedule: DataFrame, start: int, second: int, low: int, high: int, last: int) -> DataFrame:
    """Traces that break a rule: tps at seconds 0 and 1, a zero at the last second, and bounds in between (seconds 1 to last - 1)."""
    at = lambda s: F.max(F.when(F.col("second") == s, F.col("tps")))
    inner = F.when((F.col("second") >= 1) & (F.col("second") <= last - 1), F.col("tps"))
    a = schedule.groupBy("trace_id").agg(at(0).alias("t0"), at(1).alias("t1"), at(last).alias("end"), F.max("second").alias("last"), F.min(inner).alias("low"), F.max(inner).alias("high"))
    rules = {"start": F.col("t0") == start, "second": F.col("t1") == second, "terminal_zero": (F.col("end") == 0) & (F.col("last") == last), "minimum": F.col("low") == low, "maximum": F.col("high") == high}
    broken = F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(k)) for k, ok in rules.items()))
    return a.select("trace_id", F.explode(F.filter(broken, lambda r: r.isNotNull())).alias("rule"))


def corpus_link(df: DataFrame, rows: int, submit: str, load: str, loads: Sequence[float]) -> DataFrame:
    """(check, ok): the number of runs, one submitted count for all, and only known loads."""
    a = df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(submit).alias("s"), F.count_if(~F.coalesce(F.col(load).isin(list(loads)), F.lit(False))).alias("other"))
    checks = F.array(*(F.struct(F.lit(k).alias("check"), ok.alias("ok")) for k, ok in (("rows", F.col("n") == rows), ("one_submitted_count", F.col("s") == 1), ("known_loads", F.col("other") == 0))))
    return a.select(F.explode(checks).alias("c")).select("c.*")
