"""What a corpus holds: configurations, batches, identifiers and their nesting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def config_inventory(df: DataFrame, cfg: Sequence[str], batch: str, time: str) -> DataFrame:
    return df.groupBy(*cfg).agg(F.count(F.lit(1)).alias("n_runs"), F.countDistinct(batch).alias("n_batches"), F.min(time).alias("first_ts"), F.max(time).alias("last_ts"))


def batch_inventory(df: DataFrame, cfg: Sequence[str], batch: str, run: str, time: str) -> DataFrame:
    """Each batch with its (least) configuration, which is the only one where batches are nested."""
    least = F.min(F.struct(*cfg)).alias("c")
    out = df.groupBy(batch).agg(least, F.count(F.lit(1)).alias("n_runs"), F.min(run).alias("run_min"), F.max(run).alias("run_max"), F.min(time).alias("first_ts"), F.max(time).alias("last_ts"))
    return out.select(batch, "c.*", "n_runs", "run_min", "run_max", "first_ts", "last_ts")


def distribution(df: DataFrame, keys: Sequence[str], name: str = "n_members") -> DataFrame:
    """How many groups have how many rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias("n_groups"))


def missing_keys(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*(F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in columns))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of several rows, with their number; the counts are combined before the shuffle."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def crossing_batches(df: DataFrame, cfg: Sequence[str], batch: str) -> DataFrame:
    """Batches that lie in several configurations; a null level counts as a level."""
    return df.groupBy(batch).agg(F.countDistinct(F.struct(*(F.struct(c) for c in cfg))).alias("n_configs")).filter("n_configs > 1")


def identifier_audit(df: DataFrame, cfg: Sequence[str], batch: str, run: str, time: str) -> DataFrame:
    """(check, least, middle, most) of how identifiers nest: medians are exact."""
    pairs = df.select(*cfg, batch).distinct()
    parts = {
        "configs_per_batch": pairs.groupBy(batch).count(),
        "batches_per_config": pairs.groupBy(*cfg).count(),
        "configs_per_run_index": df.select(*cfg, run).distinct().groupBy(run).count(),
        "runs_per_batch": df.groupBy(batch).count(),
        "times_per_batch": df.select(batch, time).distinct().groupBy(batch).count(),
    }
    rows = [
        p.agg(F.lit(k).alias("check"), F.min("count").alias("least"), F.percentile("count", F.lit(0.5)).alias("middle"), F.max("count").alias("most"), F.count_if(F.col("count") == 1).alias("n_single"), F.count_if(F.col("count") > 1).alias("n_repeated"))
        for k, p in parts.items()
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def batch_structure(df: DataFrame, cfg: Sequence[str], batch: str) -> DataFrame:
    sizes = df.groupBy(*cfg, batch).agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy(*cfg).agg(F.count(F.lit(1)).alias("n_batches"), F.sum("n").alias("n_runs"), F.count_if(F.col("n") >= 2).alias("n_repeated_batches"), F.min("n").alias("batch_min"), F.max("n").alias("batch_max"))


def corpus_summary(df: DataFrame, cfg: Sequence[str], batch: str) -> DataFrame:
    """One row: rows, configurations, batches, and the sorted levels of each factor."""
    levels = [F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), ",").alias(f"levels_{c}") for c in cfg]
    cells = df.groupBy(*cfg).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("n_configs"), F.min("n").alias("runs_min"), F.max("n").alias("runs_max"))
    return df.agg(F.count(F.lit(1)).alias("n_runs"), F.countDistinct(batch).alias("n_batches"), *levels).crossJoin(cells)  # of one row each
