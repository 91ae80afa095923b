"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.shared import join_split, materialize


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star round over edges (low, high). A hub's rows stay where they are, only its least neighbour is sent."""
    both = edges.select(F.col("low").alias("u"), F.col("high").alias("v")).union(edges.select("high", "low"))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("__n")).withColumn("m", F.least("u", "m"))
    large = join_split(both.where("v > u"), least, "u", "__n").where("v > m").select(F.col("m").alias("low"), F.col("v").alias("high")).distinct()
    large = materialize(large)
    least = large.groupBy("high").agg(F.min("low").alias("m"))
    small = large.join(least, "high")
    return small.where("low > m").select(F.col("m").alias("low"), F.col("low").alias("high")).union(least.select("m", "high")).distinct()


def components(edges: DataFrame, low: str, high: str) -> DataFrame:
    """(node, root) for each node that an edge names but the roots themselves; root is the least node reachable.

    Each round writes its edges to the shared folder, so the lineage stays short, and the rounds end
    when one changes nothing; they are about the logarithm of the longest chain. Loops and nulls are ignored,
    repeated edges count once, and no edges give no rows.
    """
    ends = F.least(low, high), F.greatest(low, high)
    now = materialize(edges.where(F.col(low) != F.col(high)).select(ends[0].alias("low"), ends[1].alias("high")).distinct())
    state = None
    while True:
        was, state = state, now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first()
        if state == was or not state[0]:
            return now.select(F.col("high").alias("node"), F.col("low").alias("root"))
        now = materialize(_stars(now))
