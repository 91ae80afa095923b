"""Tables by factor: accounts, grids, medians, swings and marks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evenkeel.functions.cells import join_cells
from evenkeel.functions.selection import in_sets, quantiles_of_columns
from evenkeel.functions.storage import materialize
from evenkeel.operators.outcomes import regime


def offered_vs_committed(df: DataFrame, key_sets: Sequence[Sequence[str]]) -> DataFrame:
    """Counts and medians over submitted runs for several key sets at once; a key outside its set is null."""
    keys = list(dict.fromkeys(k for s in key_sets for k in s))
    on = F.col("submitted")
    values = {"median_load": F.col("load"), "median_tps": F.when(F.col("positive"), F.col("tps")), "median_commit_pct": F.when(F.col("submit") > 0, 100 * F.col("commit") / F.col("submit"))}
    flat = materialize(df.select(*keys, "submitted", "positive", *(F.when(on, c).alias(n) for n, c in values.items())))
    rows, by = in_sets(flat, key_sets, ["submitted", "positive", *values]), ["__set", *keys]
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_runs"), F.count_if(on).alias("n_submitted"), F.count_if(F.col("positive")).alias("n_positive"))
    return join_cells(counts, quantiles_of_columns(rows, by, list(values), {"median": 0.5}, "{column}"), by).drop("__set")


def catalog_accounting(counts: DataFrame, key: str, catalog: DataFrame | None = None) -> DataFrame:
    """Cells and runs by one factor; with a catalog its rows stay even where no run is, and its key must be unique (join on at most one row)."""
    out = counts.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_cells"), F.sum("n_observed").alias("n_runs"), F.sum("n_positive_commit").alias("n_positive"), F.sum("n_zero_commit").alias("n_zero"), F.sum("n_no_submission").alias("n_none"), F.min("n_observed").alias("cell_min"), F.max("n_observed").alias("cell_max")
    )
    return out if catalog is None else join_cells(catalog, out, [key], "left")


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """A join whose sides must have unique keys; repeated keys raise when the rows are read."""

    def unique(df: DataFrame) -> DataFrame:
        n = F.count(F.lit(1)).over(W.partitionBy(*keys))
        return df.withColumn("__n", n).filter(F.when(F.col("__n") == 1, F.lit(True)).otherwise(F.raise_error(F.lit("a join key is not unique")).cast("boolean"))).drop("__n")

    return join_cells(unique(left), unique(right), keys, how)


def factor_grid(df: DataFrame, factors: Sequence[str], flag: str) -> DataFrame:
    """Runs that count in each combination of levels, none included. A grid has the product of the level counts as its rows."""
    levels = reduce(lambda a, b: a.crossJoin(b), [df.select(f).distinct() for f in factors])
    counts = df.groupBy(*factors).agg(F.count_if(F.col(flag)).alias("n"))
    return join_cells(levels, counts, factors, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def grid_gaps(grid: DataFrame, sparse: int = 5) -> DataFrame:
    return grid.filter(F.col("n") < sparse).withColumn("kind", F.when(F.col("n") == 0, "empty").otherwise("sparse"))


def cells_without(df: DataFrame, keys: Sequence[str], flag: str) -> DataFrame:
    """Cells that were observed but have no run that counts."""
    return join_cells(df.select(*keys).distinct(), df.filter(F.col(flag)).select(*keys).distinct(), keys, "left_anti")


def single_outcome_cells(df: DataFrame, keys: Sequence[str], flag: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.countDistinct(flag).alias("n"), F.max(flag).alias("value")).filter("n = 1").drop("n")


def outcome_rollup(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells by regime and runs by outcome for a factor pair, with the grand total (its keys are null)."""
    is_ = lambda r: F.count_if(F.col("service_regime") == r)
    sums = ("n_observed", "n_positive_commit", "n_zero_commit", "n_no_submission", "n_inconsistent", "n_tps_valid", "n_latency_valid")
    return counts.groupingSets([[F.col(k) for k in keys], []], *(F.col(k) for k in keys)).agg(
        F.count(F.lit(1)).alias("n_cells"), is_("all_positive").alias("n_all_positive"), is_("mixed").alias("n_mixed"), is_("no_positive").alias("n_no_positive"), *(F.sum(c).alias(c) for c in sums)
    )


def medians_by(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    return quantiles_of_columns(materialize(df.select(*keys, *values)), keys, values, {"median": 0.5}, "median_{column}")


def medians_by_sets(df: DataFrame, key_sets: Sequence[Sequence[str]], values: Sequence[str]) -> DataFrame:
    """medians_by for several key sets at once; a key outside its set is null."""
    keys = list(dict.fromkeys(k for s in key_sets for k in s))
    rows = in_sets(materialize(df.select(*keys, *values)), key_sets, values)
    return quantiles_of_columns(rows, ["__set", *keys], values, {"median": 0.5}, "median_{column}").drop("__set")


def scaling_pivot(df: DataFrame, key: str, size: str, levels: Sequence[str], value: str) -> DataFrame:
    """The median of value for each key (rows) and size (columns)."""
    columns = [f"__{i}" for i in range(len(levels))]
    rows = materialize(df.select(key, *(F.when(F.col(size) == x, F.col(value)).alias(c) for x, c in zip(levels, columns))))
    return quantiles_of_columns(rows, [key], columns, {"median": 0.5}, "{column}").select(key, *(F.col(c).alias(str(x)) for x, c in zip(levels, columns)))


def worst_swings(cells: DataFrame, key: str, name: str) -> DataFrame:
    c = lambda s: F.col(f"{name}_{s}")
    zero = F.lit(0.0)
    return cells.groupBy(key).agg(
        F.max(c("max") - c("min")).alias("max_range"), F.max(F.greatest(c("mean") - c("min"), zero)).alias("max_drop"), F.max(F.greatest(c("max") - c("mean"), zero)).alias("max_rise"),
        F.max(F.when(c("mean") > 0, F.greatest(100 * (c("mean") - c("min")) / c("mean"), zero))).alias("max_drop_pct"), F.max(F.when(c("mean") > 0, F.greatest(100 * (c("max") - c("mean")) / c("mean"), zero))).alias("max_rise_pct"),
    )


def bar_summary(cells: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    c = lambda s: F.col(f"{name}_{s}")
    low, high = F.when(c("mean") > 0, 100 * (c("min") - c("mean")) / c("mean")), F.when(c("mean") > 0, 100 * (c("max") - c("mean")) / c("mean"))
    return cells.groupBy(*keys).agg(F.avg(c("mean")).alias("mean"), F.avg(c("min")).alias("min"), F.avg(c("max")).alias("max"), F.min(low).alias("pct_min"), F.max(high).alias("pct_max"), (F.count(low) + F.count(high) == 0).alias("all_missing"))


def best_worst(df: DataFrame, block: Sequence[str], value: str, tolerance: float = 1e-9) -> DataFrame:
    """Marks the least and the greatest value of a block, where it has two distinct finite ones."""
    w = W.partitionBy(*block)
    lo, hi, v = F.min(value).over(w), F.max(value).over(w), F.col(value)
    near = lambda a: F.coalesce((lo < hi) & (F.abs(v - a) <= tolerance * F.greatest(F.abs(v), F.abs(a))), F.lit(False))
    return df.withColumns({"is_min": near(lo), "is_max": near(hi)})


def factor_means(cells: DataFrame, factors: Sequence[str], statistics: Sequence[str], keys: Sequence[str] = (), least: int = 2) -> DataFrame:
    """Mean and median of cell statistics for each level of each factor within the keys (such as scope and chain): the cells, those
    with enough values, and how many values these have."""
    levels = F.explode(F.array(*(F.struct(F.lit(f).alias("factor"), F.col(f).cast("string").alias("level")) for f in factors))).alias("l")
    own = cells.select(levels, *keys, "metric", "n_metric", *statistics).select("l.*", *keys, "metric", "n_metric", *statistics)
    enough = F.col("n_metric") >= least
    of = lambda c: F.when(enough, F.col(c))
    return own.groupBy("factor", "level", *keys, "metric").agg(
        F.count(F.lit(1)).alias("n_cells"), F.count_if(enough).alias("n_contributing"), F.coalesce(F.sum(of("n_metric")), F.lit(0)).alias("n_values"), F.coalesce(F.min(of("n_metric")), F.lit(0)).alias("n_min"),
        F.coalesce(F.max(of("n_metric")), F.lit(0)).alias("n_max"), *(f(of(s)).alias(f"{n}_{s}") for s in statistics for n, f in (("mean", F.avg), ("median", F.median))),
    )
