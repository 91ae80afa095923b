"""Places of rows within classes that no single task has to hold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evenkeel.functions.cells import cell_key, join_cells
from evenkeel.functions.storage import materialize

#: Largest number of rows that a small side may have to be broadcast.
BROADCAST_ROWS = 200_000


def gapless_rank(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str, classes: int | None = None) -> DataFrame:
    """Adds name: the place (from 0, without gaps) of each row within its ``by`` class, in ``order``.

    No class is gathered into one task: rows are dealt by ranges of (by, order, salt), so that even a
    class or key with most of the rows spreads; each range numbers its rows, and the counts of each
    (range, class) give the offsets. Null ``by`` levels are levels; ``classes``, where known, bounds their number.
    df is read twice (once to find the ranges), so pass a table that is cheap to read.
    """
    rank, place, part = f"__{name}_rank", f"__{name}_place", f"__{name}_part"
    dealt = (
        df.withColumn(rank, F.xxhash64(F.monotonically_increasing_id()))
        .repartitionByRange(*by, *order, rank)
        .sortWithinPartitions(*by, *order)
        .withColumn(place, F.monotonically_increasing_id())
    )
    rows = materialize(dealt.drop(rank)).withColumns({part: F.shiftright(place, 33), place: F.col(place).bitwiseAND((1 << 33) - 1)})
    heads = rows.groupBy(part, *by).agg(F.min(place).alias("__first"), F.count(F.lit(1)).alias("__rows"))
    before = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(part, *by, (F.coalesce(F.sum("__rows").over(before), F.lit(0)) - F.col("__first")).alias("__shift"))
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if classes is not None and ranges + classes <= BROADCAST_ROWS:  # heads has at most this many rows
        heads = F.broadcast(heads)
    return join_cells(rows, heads, [part, *by]).withColumn(name, F.col(place) + F.col("__shift")).drop(part, place, "__shift")


def counted_upto(counts: DataFrame, key: str) -> DataFrame:
    """key, __v, __c of distinct values with counts, and __n (rows of the key) and __upto (rows up to and with the value): dealt by ranges, so that no key is gathered."""
    part, place = "__part", "__place"
    dealt = counts.repartitionByRange(key, "__v").sortWithinPartitions(key, "__v").withColumn(place, F.monotonically_increasing_id())
    rows = materialize(dealt).withColumn(part, F.shiftright(place, 33))
    heads = rows.groupBy(part, key).agg(F.sum("__c").alias("__rows"))
    of_class = Window.partitionBy(key)
    before = of_class.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(part, key, F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"), F.sum("__rows").over(of_class).alias("__n"))
    within = Window.partitionBy(part, key).orderBy(place)
    return rows.withColumn("__own", F.sum("__c").over(within)).join(heads, [part, key]).withColumn("__upto", F.col("__before") + F.col("__own"))


def quantiles(df: DataFrame, by: Sequence[str], value: str, points: Sequence[float], names: Sequence[str]) -> DataFrame:
    """by and the exact interpolated quantiles of the values that are not null; classes without any have no row.

    Equal values are counted before the first shuffle; the distinct ones are dealt by ranges, so that no class is
    gathered, and only the two values around each point come together.
    """
    key = "__key"
    counts = df.filter(F.col(value).isNotNull()).groupBy(cell_key(by).alias(key), F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    upto = counted_upto(counts, key)
    at = lambda k: F.min(F.when(F.col("__upto") > k, F.col("__v")))
    h = lambda p: (F.col("__n") - 1) * F.lit(float(p))
    found = upto.groupBy(key).agg(F.first("__n").alias("__n"), *(at(f(h(p))).alias(f"__{n}_{s}") for p, n in zip(points, names) for s, f in (("a", F.floor), ("b", F.ceil))))
    share = lambda p: h(p) - F.floor(h(p))
    return found.select(f"{key}.*", *(((1 - share(p)) * F.col(f"__{n}_a") + share(p) * F.col(f"__{n}_b")).alias(n) for p, n in zip(points, names)))
