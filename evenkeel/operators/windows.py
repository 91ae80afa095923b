"""Run-level deviations, offsets and contrasts in time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.functions.cells import join_cells
from evenkeel.functions.numbers import percent
from evenkeel.functions.ranks import gapless_rank
from evenkeel.functions.selection import quantiles_of_columns
from evenkeel.functions.storage import materialize


def deviations(df: DataFrame, cfg: Sequence[str], value: str, eligible: str) -> DataFrame:
    """Eligible runs with their absolute and relative deviation from the cell mean, the latter clipped at 100 % too.

    Means are aggregated and joined back, so no cell is gathered.
    """
    runs = df.filter(F.col(eligible))
    out = join_cells(runs, runs.groupBy(*cfg).agg(F.avg(value).alias("cell_mean")), cfg)
    out = out.withColumns({"deviation": F.col(value) - F.col("cell_mean"), "deviation_pct": percent(F.col(value) - F.col("cell_mean"), F.col("cell_mean"))})
    return out.withColumns({"clipped_pct": F.greatest(F.least("deviation_pct", F.lit(100.0)), F.lit(-100.0)), "overflow": F.coalesce(F.abs("deviation_pct") > 100 + 1e-9, F.lit(False))})


def uncentred(deviations: DataFrame, cfg: Sequence[str], tolerance: float = 1e-8) -> DataFrame:
    """Cells whose deviations sum to more than the tolerance, for each of their runs and as large as their means."""
    room = tolerance * F.greatest(F.max(F.abs("cell_mean")), F.lit(1.0)) * F.count(F.lit(1))
    return deviations.groupBy(*cfg).agg(F.sum("deviation").alias("total"), room.alias("__room")).filter(F.abs("total") > F.col("__room")).drop("__room")


def _placed(df: DataFrame, cfg: Sequence[str], order: Sequence[str]) -> DataFrame:
    """df with __place (from 0) in its cell and the cell's __n, by ranges that split large cells."""
    rows = materialize(df)
    return join_cells(gapless_rank(rows, cfg, order, "__place"), rows.groupBy(*cfg).agg(F.count(F.lit(1)).alias("__n")), cfg)


def offsets(df: DataFrame, cfg: Sequence[str], order: Sequence[str], half: float = 0.18) -> DataFrame:
    """An offset in [-half, half] by rank in the cell; a lone row gets 0."""
    place = F.when(F.col("__n") == 1, F.lit(0.0)).otherwise(-half + 2 * half * F.col("__place") / (F.col("__n") - 1))
    return _placed(df, cfg, order).withColumn("offset", place).drop("__place", "__n")


def halves(df: DataFrame, cfg: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of the early and the late half of each cell; a middle row is left out."""
    part = F.floor(F.col("__n") / 2)
    period = F.when(F.col("__place") < part, "early").when(F.col("__place") >= F.col("__n") - part, "late")
    return _placed(df, cfg, order).withColumn("period", period).filter("period IS NOT NULL").drop("__place", "__n")


def end_batches(df: DataFrame, cfg: Sequence[str], batch: str, order: Sequence[str]) -> DataFrame:
    """Rows of the batch that appears first in its cell and of the one that appears last; cells of one batch are left out."""
    first = df.groupBy(*cfg, batch).agg(F.min(F.struct(*order)).alias("__seen"))
    ends = first.groupBy(*cfg).agg(F.min(F.struct("__seen", batch)).alias("__a"), F.max(F.struct("__seen", batch)).alias("__b")).filter(~F.col(f"__a.{batch}").eqNullSafe(F.col(f"__b.{batch}")))
    both = ends.select(*cfg, F.explode(F.array(*(F.struct(F.col(f"{e}.{batch}").alias(batch), F.lit(p).alias("period")) for e, p in (("__a", "early"), ("__b", "late"))))).alias("__x")).select(*cfg, "__x.*")
    return join_cells(df, both, [*cfg, batch])


def period_contrast(df: DataFrame, cfg: Sequence[str], metrics: dict[str, tuple[str, str]]) -> DataFrame:
    """For each cell the late minus early share of positive runs, in points, and the change of each metric's median in percent."""
    of = lambda p, c: F.when(F.col("period") == p, c)
    halves_ = ("early", "late")
    own = {f"__{name}_{p}": of(p, F.when(F.col(eligible), F.col(value))) for name, (value, eligible) in metrics.items() for p in halves_}
    rows = materialize(df.select(*cfg, *(of(p, F.col("positive").cast("double")).alias(f"__{p}") for p in halves_), *(c.alias(n) for n, c in own.items())))
    shares = rows.groupBy(*cfg).agg((100 * F.avg("__late") - 100 * F.avg("__early")).alias("positive_points"))
    both = join_cells(shares, quantiles_of_columns(rows, cfg, list(own), {"median": 0.5}, "{column}"), cfg)
    change = lambda n: F.when(F.col(f"__{n}_early") > 0, 100 * (F.col(f"__{n}_late") - F.col(f"__{n}_early")) / F.col(f"__{n}_early"))
    return both.select(*cfg, "positive_points", *(change(n).alias(f"{n}_change_pct") for n in metrics))


def contrast_summary(contrast: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Quartiles over cells with a value, for each contrast."""
    long = contrast.unpivot([], list(columns), "contrast", "value")
    q = lambda p: F.percentile("value", F.lit(p))
    return long.groupBy("contrast").agg(F.count("value").alias("n_cells"), q(0.25).alias("q25"), q(0.5).alias("median"), q(0.75).alias("q75"))
