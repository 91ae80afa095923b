"""Dispersion of metrics within configurations, with one mask for all of a metric's statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.functions.cells import cell_label, join_cells
from evenkeel.functions.numbers import percent
from evenkeel.functions.ranks import quantiles
from evenkeel.functions.selection import quantiles_of_columns
from evenkeel.functions.storage import materialize
from evenkeel.plans.model import MetricSpec

PARTS = ("n_metric", "mean", "min", "max", "q25", "q75", "std")
RELATIVE = ("iqr_pct", "std_pct", "delta_min_pct", "delta_max_pct", "wcd_pct")


def long_form(df: DataFrame, keys: Sequence[str], metrics: Sequence[MetricSpec]) -> DataFrame:
    """keys, metric, v: every run once for each metric, with v null where it doesn't count. Cells without a value stay."""
    pairs = F.array(*(F.struct(F.lit(m.name).alias("metric"), F.when(F.col(m.eligible), F.col(m.value)).alias("v")) for m in metrics))
    return df.select(*keys, F.explode(pairs).alias("m")).select(*keys, "m.metric", "m.v")


def moments(v: str = "v") -> list[Column]:
    c = F.col(v)
    return [F.count(c).alias("n_metric"), F.avg(c).alias("mean"), F.min(c).alias("min"), F.max(c).alias("max"), F.stddev_samp(c).alias("std")]


def statistics(v: str = "v") -> list[Column]:
    """Moments and quartiles of groups whose values fit into a task."""
    return [*moments(v), F.percentile(v, F.lit(0.25)).alias("q25"), F.percentile(v, F.lit(0.75)).alias("q75")]


def derived() -> dict[str, Column]:
    c = F.col
    up, down = c("max") - c("mean"), c("min") - c("mean")
    wcd = F.greatest(F.abs(up), F.abs(down))
    return {
        "iqr": c("q75") - c("q25"), "iqr_pct": percent(c("q75") - c("q25"), c("mean")), "std_pct": percent(c("std"), c("mean")), "delta_min": down, "delta_max": up,
        "delta_min_pct": percent(down, c("mean")), "delta_max_pct": percent(up, c("mean")), "range": c("max") - c("min"), "wcd": wcd, "wcd_pct": percent(wcd, c("mean")),
    }


def dispersion(df: DataFrame, keys: Sequence[str], metrics: Sequence[MetricSpec]) -> DataFrame:
    """A row for each cell and metric; quartiles come from ranks by range, so no task holds a cell's values."""
    wide = materialize(df.select(*keys, *(F.when(F.col(m.eligible), F.col(m.value)).alias(f"__{i}") for i, m in enumerate(metrics)), F.lit(True).alias("__on")))
    rows, by = long_form(wide, keys, [MetricSpec(m.name, f"__{i}", "__on") for i, m in enumerate(metrics)]), [*keys, "metric"]
    cells = rows.groupBy(*by).agg(*moments()).withColumn("__cell", F.struct(*by))  # null levels are levels
    quartiles = quantiles(rows, by, "v", (0.25, 0.75), ("q25", "q75")).select(F.struct(*by).alias("__cell"), "q25", "q75")
    return cells.join(quartiles, "__cell", "left").drop("__cell").withColumns(derived())


def sorted_quantile(df: DataFrame, keys: Sequence[str], v: str, p: float) -> DataFrame:
    """The exact interpolated quantile by rank, for cells too large for the value maps of ``percentile``: no task holds a cell."""
    return quantiles(df, keys, v, [p], ["quantile"])


def scope_maxima(cells: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """For each metric and statistic its greatest value (of delta_min_pct by size) and the cell; values that agree to six digits tie, and ties go to the first cell.

    Everything comes from one pass: means summed again may differ in their last bits, so a maximum is never looked up in a second reading.
    """
    long = cells.select("metric", "n_metric", cell_label(keys).alias("cell"), *columns).unpivot(["metric", "n_metric", "cell"], list(columns), "statistic", "value")
    long = long.withColumn("size", F.round(F.when(F.col("statistic") == "delta_min_pct", F.abs("value")).otherwise(F.col("value")) + 1e-9, 6))
    place = F.when(F.col("size").isNotNull(), F.struct((~F.isnan("size")).alias("known"), (-F.col("size")).alias("down"), "cell", "value"))
    best = long.groupBy("metric", "statistic").agg(F.count("value").alias("n_estimable"), F.count_if(F.col("n_metric") >= 2).alias("n_two_values"), F.min(place).alias("top"))
    return best.select("metric", "statistic", "n_estimable", "n_two_values", "top.cell", "top.value")


def bounds_violations(cells: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Cells outside what arithmetic allows for non-negative values: -100 %, 100 (n - 1) %, range = max - min."""
    c = F.col
    off = (c("delta_min_pct") < -100 - tolerance) | (c("delta_max_pct") > 100 * (c("n_metric") - 1) + tolerance) | (F.abs(c("range") - (c("delta_max") - c("delta_min"))) > tolerance * F.greatest(F.lit(1.0), F.abs(c("max"))))
    return cells.filter((c("n_metric") > 0) & F.coalesce(off, F.lit(False)))


def eligibility(cells: DataFrame, keys: Sequence[str] = (), least: int = 9) -> DataFrame:
    return cells.groupBy(*keys, "metric").agg(F.count(F.lit(1)).alias("n_cells"), F.count_if(F.col("n_metric") >= least).alias("n_enough"), F.min("n_metric").alias("n_min"), F.max("n_metric").alias("n_max"))


def legacy_aggregate(df: DataFrame, keys: Sequence[str], values: dict[str, str], commit: str = "commit") -> DataFrame:
    """The older aggregate without outcome masks: quartiles are null as soon as one value is missing."""
    rows = materialize(df.select(*keys, F.col(commit).alias("__commit"), *(F.col(c).cast("double").alias(n) for n, c in values.items())))
    out = [f(n).alias(f"{n}_{s}") for n in values for s, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]
    whole = [(F.count(n) == F.count(F.lit(1))).alias(f"__{n}") for n in values]
    means = rows.groupBy(*keys).agg(*out, F.avg("__commit").alias("commit_mean"), *whole)
    both = join_cells(means, quantiles_of_columns(rows, keys, list(values), {"q25": 0.25, "median": 0.5, "q75": 0.75}), keys)
    return both.withColumns({f"{n}_{q}": F.when(F.col(f"__{n}"), F.col(f"{n}_{q}")) for n in values for q in ("q25", "q75")}).drop(*(f"__{n}" for n in values))


def legacy_dispersion(cells: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    out = []
    for n in names:
        c = lambda s: F.col(f"{n}_{s}")  # noqa: B023, E731
        out += [
            F.when((c("min") > 0) & (c("mean") > 0), 100 * (c("min") - c("mean")) / c("mean")).alias(f"{n}_min_pct"), percent(c("max") - c("mean"), c("mean")).alias(f"{n}_max_pct"),
            (c("q75") - c("q25")).alias(f"{n}_iqr"), percent(c("q75") - c("q25"), c("mean")).alias(f"{n}_iqr_pct"), (c("max") - c("min")).alias(f"{n}_range"), percent(c("std"), c("mean")).alias(f"{n}_std_pct"),
        ]
    return cells.select(*keys, *out)
