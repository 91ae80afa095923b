"""Exact quantiles of many groups at once, whatever their size: histograms close in on the ranks that are asked for."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evenkeel.functions.cells import cell_key, join_cells
from evenkeel.functions.storage import materialize

#: Values that one task may sort for a rank, and bins that a bracket is cut into.
SMALL, BINS = 4096, 512
_LARGEST = 1.7976931348623157e308


def _bin(v: Column, low: Column, high: Column, bins: int) -> Column:
    """The bin of a value of a bracket: never less for a larger value. Infinities have bins of their own."""
    low, high = F.greatest(low, F.lit(-_LARGEST)) / 4, F.least(high, F.lit(_LARGEST)) / 4
    inner = F.least(F.floor((v / 4 - low) / (high - low) * bins), F.lit(bins - 1).cast("long"))
    return F.when(v == float("-inf"), -1).when(v == float("inf"), bins).otherwise(F.when(high > low, inner).otherwise(0))


def _within(rows: DataFrame, brackets: DataFrame) -> DataFrame:
    """Rows of the groups' brackets (which share no value), with the ends of theirs."""
    of_group = brackets.groupBy("g").agg(F.collect_list(F.struct("low", "high")).alias("all"))  # two a point at most
    own = F.get(F.filter("all", lambda b: (F.col("v") >= b["low"]) & (F.col("v") <= b["high"])), F.lit(0))
    return rows.join(of_group, "g").withColumn("own", own).where("own IS NOT NULL").select("g", "v", "own.low", "own.high")


def quantiles_of_groups(df: DataFrame, by: Sequence[str], value: str, points: Mapping[str, float], small: int = SMALL, bins: int = BINS) -> DataFrame:
    """by and, under the names of ``points``, the exact interpolated quantiles of the values that are neither null nor NaN; groups without any have no row.

    Each round counts the values of a group's brackets in bins, before anything is shuffled, and keeps the bins that hold the
    wanted ranks, until a bracket holds ``small`` values or one value only. So a shuffle grows with groups and bins and not with
    the rows, and two or three rounds do for most data; df is read once a round: pass a written table. Null levels are levels.
    """
    v = F.col(value).cast("double")
    rows = df.select(cell_key(by).alias("g"), v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    heads = materialize(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")))
    h = {name: (F.col("n") - 1) * F.lit(float(p)) for name, p in points.items()}
    ranks = F.array_distinct(F.array(*(f(x).cast("long") for x in h.values() for f in (F.floor, F.ceil))))
    brackets = heads.select("g", "low", "high", F.lit(0).cast("long").alias("before"), F.col("n").alias("count"), ranks.alias("ranks"))
    wide = (F.col("count") > small) & (F.col("low") < F.col("high"))
    while brackets.where(wide).limit(1).count():
        own = brackets.where(wide)
        counted = _within(rows, own).groupBy("g", "low", "high", _bin(F.col("v"), F.col("low"), F.col("high"), bins).alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
        running = F.sum("c").over(Window.partitionBy("g", "low", "high").orderBy("bin"))
        placed = counted.withColumn("upto", running).join(own, ["g", "low", "high"]).withColumns({"first": F.col("before") + F.col("upto") - F.col("c"), "after": F.col("before") + F.col("upto")})
        asked = F.filter("ranks", lambda r: (r >= F.col("first")) & (r < F.col("after")))
        closer = placed.select("g", F.col("least").alias("low"), F.col("most").alias("high"), F.col("first").alias("before"), F.col("c").alias("count"), asked.alias("asked")).where(F.size("asked") > 0)
        closer = closer.withColumnRenamed("asked", "ranks")
        brackets = materialize(brackets.where(~wide).unionByName(closer))
    flat = brackets.select("g", "low", "high", "before", "ranks")
    lists = _within(rows, flat.where("low < high")).groupBy("g", "low", "high").agg(F.array_sort(F.collect_list("v")).alias("values"))  # small values each
    found = flat.join(lists, ["g", "low", "high"], "left").select("g", F.explode("ranks").alias("rank"), "before", "low", "values")
    at = F.coalesce(F.get("values", (F.col("rank") - F.col("before")).cast("int")), F.col("low"))
    known = found.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("rank", at.alias("v")))).alias("at"))

    def point(x: Column) -> Column:
        low, share = F.floor(x).cast("long"), x - F.floor(x)
        a, b = (F.element_at("at", k) for k in (low, F.ceil(x).cast("long")))
        return F.when(a == b, a).otherwise((1 - share) * a + share * b)

    return heads.select("g", "n").join(known, "g").select(*([f"g.{k}" for k in by]), *(point(x).alias(name) for name, x in h.items()))


def in_sets(df: DataFrame, key_sets: Sequence[Sequence[str]], rest: Sequence[str]) -> DataFrame:
    """Each row once for each key set, with the set's number; keys outside a set are null. A missing level stays apart from these by the number."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    keys = list(dict.fromkeys(k for s in key_sets for k in s))
    sets = F.array(*(F.struct(F.lit(i).alias("__set"), *((F.col(k) if k in s else F.lit(None).cast(kinds[k])).alias(k) for k in keys)) for i, s in enumerate(key_sets)))
    return df.select(F.explode(sets).alias("s"), *rest).select("s.*", *rest)


def quantiles_of_columns(df: DataFrame, by: Sequence[str], columns: Sequence[str], points: Mapping[str, float], name: str = "{column}_{point}") -> DataFrame:
    """by and, for every group of df, the quantiles of several columns, named by ``name``; null where a column has no value."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("__column"), F.col(c).cast("double").alias("__value")) for c in columns))).alias("p")
    found = quantiles_of_groups(df.select(*by, pairs).select(*by, "p.*"), [*by, "__column"], "__value", points)
    own = lambda c, q: F.max(F.when(F.col("__column") == c, F.col(q))).alias(name.format(column=c, point=q))
    return join_cells(df.select(*by).distinct(), found.groupBy(*by).agg(*(own(c, q) for c in columns for q in points)), by, "left")
