"""Outcome classes of runs and the flags that say on which runs a metric counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.functions.numbers import finite, integer_like, number, sure

STATES = ("positive_commit", "zero_commit", "no_submission", "inconsistent")
#: Counter of D5: name and the flag that it counts.
COUNTERS = {
    "n_submitted": "submitted", "n_positive_commit": "positive", "n_zero_commit": "zero", "n_no_submission": "none", "n_inconsistent": "inconsistent", "n_tps_valid": "tps_valid", "n_tps_censored": "tps_censored",
    "n_tps_point_valid": "tps_point_valid", "n_latency_valid": "latency_valid", "n_energy_valid_observed": "energy_valid", "n_energy_valid_positive_commit": "energy_valid_positive", "n_network_valid_observed": "network_valid",
}


def derive_outcomes(df: DataFrame, submit="submit", commit="commit", tps="tps", latency="latency", energy="energy", rx="rx", tx="tx") -> DataFrame:
    """df with number columns coerced, their values as they were in ``<name>_raw``, ``outcome`` and 12 flags that are never null.

    Counters that are missing, no number, negative, broken or contradictory make a run inconsistent.
    The flags are row expressions, so a streaming DataFrame serves as well.
    """
    counters = list(dict.fromkeys((submit, commit, tps, latency, energy, rx, tx)))
    df = df.withColumns({f"{c}_raw": F.col(c) for c in counters}).withColumns({c: number(F.col(c)) for c in counters})
    s, c = F.col(submit), F.col(commit)
    ok = integer_like(s) & integer_like(c) & sure(s >= 0) & sure(c >= 0) & sure(c <= s)
    state = F.when(~ok, "inconsistent").when(c > 0, "positive_commit").when(s > 0, "zero_commit").otherwise("no_submission")
    df = df.withColumn("outcome", state)
    is_ = lambda *names: F.col("outcome").isin(*names)
    at_least = lambda name, above=False: finite(F.col(name)) & sure(F.col(name) > 0 if above else F.col(name) >= 0)
    positive = is_("positive_commit")
    return df.withColumns({
        "submitted": is_("positive_commit", "zero_commit"), "positive": positive, "zero": is_("zero_commit"), "none": is_("no_submission"), "inconsistent": is_("inconsistent"),
        "tps_valid": positive & at_least(tps), "tps_censored": positive & at_least(tps) & sure(F.col(tps) == 0), "tps_point_valid": positive & at_least(tps, True),
        "latency_valid": positive & at_least(latency, True), "energy_valid": at_least(energy), "energy_valid_positive": positive & at_least(energy), "network_valid": at_least(rx) & at_least(tx),
    })


def flag_violations(df: DataFrame) -> DataFrame:
    """Rows whose outcome flags disagree: a submitted run has two of them, any other has one."""
    n = sum((F.col(c).cast("int") for c in ("submitted", "positive", "zero", "none", "inconsistent")), F.lit(0))
    return df.filter(n != F.when(F.col("submitted"), 2).otherwise(1))


def regime(n_positive: Column, n: Column) -> Column:
    return F.when(n_positive == n, "all_positive").when(n_positive == 0, "no_positive").otherwise("mixed")


def outcome_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The 13 counters of each key, and its service regime."""
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_observed"), *(F.count_if(F.col(f)).alias(n) for n, f in COUNTERS.items()))
    return out.withColumn("service_regime", regime(F.col("n_positive_commit"), F.col("n_observed")))


def status_counts(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A row for each key and state, those of no run too."""
    counts = df.groupBy(*keys).agg(*(F.count_if(F.col("outcome") == s).alias(s) for s in STATES))
    return counts.unpivot(list(keys), list(STATES), "outcome", "n_runs")


def scope_summary(counts: DataFrame, least: int = 9) -> DataFrame:
    """One row about all cells of outcome_counts."""
    is_ = lambda r: F.count_if(F.col("service_regime") == r)
    return counts.agg(
        F.count(F.lit(1)).alias("n_cells"), F.sum("n_observed").alias("n_runs"), is_("all_positive").alias("n_all_positive"), is_("mixed").alias("n_mixed"), is_("no_positive").alias("n_no_positive"),
        F.count_if(F.col("n_positive_commit") >= least).alias("n_cells_enough_positive"), *(F.sum(c).alias(f"total_{c[2:]}") for c in COUNTERS),
    )


def legacy_ratios(df: DataFrame, commit="commit", submit="submit", latency="latency", load="load", energy="energy") -> DataFrame:
    """The older projections: commit ratio and latency per load with missing as 0, and negative energy as missing.
    A positive number over 0 is infinite, as in IEEE arithmetic."""

    def ratio(a: str, b: str) -> Column:
        over_zero = F.when((F.col(b) == 0) & (F.col(a) > 0), F.lit(float("inf")))
        return F.coalesce(over_zero, F.try_divide(F.col(a), F.col(b)), F.lit(0.0))

    return df.withColumns({"commit_ratio": ratio(commit, submit), "latency_per_load": ratio(latency, load), "energy_clean": F.when(F.col(energy) >= 0, F.col(energy))})


def compact(positive: str = "n_positive_commit", zero: str = "n_zero_commit", none: str = "n_no_submission") -> Column:
    return F.concat_ws("/", positive, zero, none)
