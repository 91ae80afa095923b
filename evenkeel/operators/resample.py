"""Balanced samples whose draws depend only on seed, replicate and cell, never on partitioning, and summaries over replicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.functions.cells import cell_key, cell_label, join_cells
from evenkeel.functions.ranks import gapless_rank
from evenkeel.functions.storage import materialize
from evenkeel.operators.dispersion import derived, long_form, statistics
from evenkeel.plans.model import MetricSpec

#: Most draws (three numbers each) that are sent to the rows rather than the rows to them.
FEW_DRAWS = 1_000_000


def draw_key(seed: int, replicate: Column, row: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), replicate.cast("string"), row.cast("string")))


def draw(seed: int, replicate: Column, row: Column) -> Column:
    """A 60-bit number."""
    return F.conv(F.substring(draw_key(seed, replicate, row), 1, 15), 16, 10).cast("long")


def short_cells(df: DataFrame, cfg: Sequence[str], n: int) -> DataFrame:
    return df.groupBy(*cfg).agg(F.count(F.lit(1)).alias("n_runs")).filter(F.col("n_runs") < n)


def long_enough(df: DataFrame, cfg: Sequence[str], n: int) -> DataFrame:
    """Rows of the cells that have n or more."""
    return join_cells(df, materialize(short_cells(df, cfg, n).select(*cfg)), cfg, "left_anti")


def _spread(df: DataFrame) -> DataFrame:
    """df dealt over all shuffle partitions: few small rows that are about to become many."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def balanced_sample(df: DataFrame, cfg: Sequence[str], row_id: str, n: int, seed: int, replicates: int = 5000) -> DataFrame:
    """n rows of each cell in each replicate, without replacement and before any mask; a cell with fewer rows raises when it is read.

    Rows are numbered once in their cell, by ranges, cells going by numbers. A replicate draws n numbers of a cell: the k-th is drawn
    from the first N - n + k, and is N - n + k itself if that number is taken, which makes all subsets equally likely. So the
    draws grow with cells and replicates and not with the rows, and where they are few the rows stay where they are.
    """
    rows = materialize(df)
    cells = rows.groupBy(*cfg).agg(F.count(F.lit(1)).alias("__n")).select(cell_key(cfg).alias("__cell"), "__n", cell_label(cfg).alias("__label"))
    cells = materialize(cells.withColumn("__id", F.monotonically_increasing_id()))
    n_cells = cells.count()
    rest = [c for c in rows.columns if c not in cfg]
    numbered = rows.withColumn("__cell", cell_key(cfg)).join(cells.select("__cell", "__id"), "__cell").select("__id", *rest)
    placed = gapless_rank(numbered, ["__id"], [row_id], "__place", n_cells)
    enough = F.when(F.col("__n") >= n, F.col("__n")).otherwise(F.raise_error(F.concat_ws(" ", F.lit("too few rows in cell"), *(F.col("__cell")[c] for c in cfg))).cast("long"))
    each = _spread(cells.select("__id", "__label", enough.alias("__n"), F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate")))

    def add(taken: Column, k: Column) -> Column:
        last = F.col("__n") - n + k
        number = F.pmod(draw(seed, F.col("replicate"), F.concat_ws("|", "__label", k.cast("string"))), last)
        return F.concat(taken, F.array(F.when(F.array_contains(taken, number), last - 1).otherwise(number)))

    places = F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.array().cast("array<bigint>"), add)
    drawn = each.select("__id", "replicate", F.explode(places).alias("__place"))
    if n_cells * replicates * n <= FEW_DRAWS:
        drawn = F.broadcast(drawn)
    return placed.join(drawn, ["__id", "__place"]).join(cells.select("__id", "__cell"), "__id").select("__cell.*", "replicate", *rest)


def summary(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Over replicates: how many are defined, their median, 95 % interval and ends."""
    v = F.when(F.abs(value) < float("inf"), F.col(value))
    q = lambda p: F.percentile(v, F.lit(p))
    return df.groupBy(*keys).agg(F.count(v).alias("n_defined"), q(0.5).alias("median"), q(0.025).alias("lower"), q(0.975).alias("upper"), F.min(v).alias("min"), F.max(v).alias("max"))


def replicate_cells(sample: DataFrame, cfg: Sequence[str], metrics: Sequence[MetricSpec]) -> DataFrame:
    return long_form(sample, [*cfg, "replicate"], metrics).groupBy(*cfg, "metric", "replicate").agg(*statistics()).withColumns(derived())


def long_statistics(cells: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return cells.select(*keys, *(F.col(c).cast("double").alias(c) for c in columns)).unpivot(list(keys), list(columns), "statistic", "value")


def config_sensitivity(sample: DataFrame, primary: DataFrame, cfg: Sequence[str], metrics: Sequence[MetricSpec], columns: Sequence[str]) -> DataFrame:
    """Each cell's primary estimate beside the summary of its replicates."""
    replicates = summary(long_statistics(replicate_cells(sample, cfg, metrics), [*cfg, "metric", "replicate"], columns), [*cfg, "metric", "statistic"])
    own = long_statistics(primary, [*cfg, "metric"], columns).withColumnRenamed("value", "primary")
    return join_cells(own, replicates, [*cfg, "metric", "statistic"])


def by_level(cells: DataFrame, factors: Sequence[str], rest: Sequence[str]) -> DataFrame:
    """Each cell once for each factor, with the factor's name and the cell's level of it."""
    levels = F.explode(F.array(*(F.struct(F.lit(f).alias("factor"), F.col(f).cast("string").alias("level")) for f in factors))).alias("l")
    return cells.select(levels, *rest).select("l.*", *rest)


def _over_cells(long: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Mean and median of value over the cells of each key, NaN and infinities left out."""
    v = F.when(F.abs("value") < float("inf"), F.col("value"))
    both = long.groupBy(*keys).agg(F.avg(v).alias("mean"), F.median(v).alias("median"))
    return both.unpivot(list(keys), ["mean", "median"], "over_cells", name)


def factor_sensitivity(drawn: DataFrame, primary: DataFrame, factors: Sequence[str], columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Mean and median over cells by factor level (and keys, such as a scope): the number of cells, the primary's value, and
    the summary of those of the replicates."""
    level = ["factor", "level", *keys, "metric"]
    by = long_statistics(by_level(drawn, factors, [*keys, "metric", "replicate", *columns]), [*level, "replicate"], columns)
    out = summary(_over_cells(by, [*level, "replicate", "statistic"], "value"), [*level, "statistic", "over_cells"])
    own = by_level(primary, factors, [*keys, "metric", *columns])
    point = _over_cells(long_statistics(own, level, columns), [*level, "statistic"], "primary")
    counted = join_cells(point, own.groupBy(*level).agg(F.count(F.lit(1)).alias("n_cells")), level)
    return join_cells(counted, out, [*level, "statistic", "over_cells"], "left")


def factor_intervals(drawn: DataFrame, primary: DataFrame, cfg: Sequence[str], within: str, factors: Sequence[str], columns: Sequence[str], keys: Sequence[str] = (), least: int = 2) -> DataFrame:
    """Mean and median over cells by factor level within each level of another factor: cells and those that contribute (a defined
    value from ``least`` or more), their values, the point estimate, and the 95 % interval over replicates of the same cells."""
    cell, level = [*cfg, *keys, "metric"], ["factor", "level", within, *keys, "metric"]
    rest = list(dict.fromkeys([*cell, within]))
    own = long_statistics(primary.withColumn("n_metric", F.col("n_metric").cast("long")), [*rest, "n_metric"], columns)
    used = own.filter((F.abs("value") < float("inf")) & (F.col("n_metric") >= least))
    kept = join_cells(long_statistics(drawn, [*rest, "replicate"], columns), used, [*cell, "statistic"], "left_semi")
    named = lambda df, extra: by_level(df, factors, [*dict.fromkeys([within, *keys, "metric", "statistic", *extra])])
    total = named(own, []).groupBy(*level, "statistic").agg(F.count(F.lit(1)).alias("n_cells"))
    contributing = named(used, ["n_metric", "value"])
    counts = contributing.groupBy(*level, "statistic").agg(F.count(F.lit(1)).alias("n_contributing"), F.sum("n_metric").alias("n_values"), F.min("n_metric").alias("n_min"), F.max("n_metric").alias("n_max"))
    point = _over_cells(contributing, [*level, "statistic"], "point")
    ends = summary(_over_cells(named(kept, ["replicate", "value"]), [*level, "statistic", "replicate"], "value"), [*level, "statistic", "over_cells"]).select(*level, "statistic", "over_cells", "lower", "upper")
    both = F.explode(F.array(F.lit("mean"), F.lit("median"))).alias("over_cells")
    out = join_cells(total, counts, [*level, "statistic"], "left").select("*", both)
    out = join_cells(join_cells(out, point, [*level, "statistic", "over_cells"], "left"), ends, [*level, "statistic", "over_cells"], "left")
    return out.fillna(0, ["n_contributing", "n_values", "n_min", "n_max"])


def extrema_sensitivity(cells: DataFrame, primary: DataFrame, columns: dict[str, str], keys: Sequence[str] = ()) -> DataFrame:
    """The greatest or least cell value of each statistic (columns says max or min for each) in each replicate: the primary's, and the summary."""
    ends = lambda df, by: df.groupBy(*by).agg(*(getattr(F, f)(c).alias(c) for c, f in columns.items()))
    drawn = long_statistics(ends(cells, [*keys, "metric", "replicate"]), [*keys, "metric", "replicate"], list(columns))
    own = long_statistics(ends(primary, [*keys, "metric"]), [*keys, "metric"], list(columns)).withColumnRenamed("value", "primary")
    direction = F.create_map(*(F.lit(x) for c, f in columns.items() for x in (c, f)))
    return join_cells(own, summary(drawn, [*keys, "metric", "statistic"]), [*keys, "metric", "statistic"]).withColumn("direction", F.element_at(direction, F.col("statistic")))


def denominators(sample: DataFrame, primary: DataFrame, cfg: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """How many runs of each cell have each flag: in the primary rows, and the summary over replicates."""
    count = lambda df, by: long_statistics(df.groupBy(*by).agg(*(F.count_if(F.col(f)).alias(f) for f in flags)), by, flags)
    own = count(primary, [*cfg]).withColumn("primary", F.col("value").cast("long")).drop("value")
    return join_cells(own, summary(count(sample, [*cfg, "replicate"]), [*cfg, "statistic"]), [*cfg, "statistic"])


def outside(point: Column, lower: Column, upper: Column, tolerance: float = 1e-9) -> Column:
    """Whether a point lies outside its interval by more than the tolerance of sums in another order."""
    near = tolerance * F.greatest(F.abs(point), F.lit(1.0))
    return F.coalesce((point < lower - near) | (point > upper + near), F.lit(False))


def interval_violations(df: DataFrame) -> DataFrame:
    """Rows whose interval is reversed or half defined."""
    defined = F.col("n_defined") > 0
    return df.filter(F.when(defined, F.coalesce(F.col("lower") > F.col("upper"), F.lit(True))).otherwise(F.col("lower").isNotNull() | F.col("upper").isNotNull()))
