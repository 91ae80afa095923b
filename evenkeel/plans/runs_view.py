"""Orders as a corpus of runs: an order is a run, its lines are what it submits and commits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evenkeel.operators.outcomes import derive_outcomes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order. Lines are summed by order before they meet the orders, and the dimension joins are left to the optimizer's sizes."""
    done = F.col("l_linestatus") == "F"
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate", "o_totalprice")
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.sum("l_quantity").alias("submit"), F.sum(F.when(done, F.col("l_quantity"))).alias("commit"),
            F.sum(F.when(done, F.datediff("l_shipdate", F.lit("1970-01-01")))).alias("ship_days"), F.count_if(done).alias("n_done"),
            F.sum("l_extendedprice").alias("rx"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("tx"),
        )
    )
    customers = (
        table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal")
        .join(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    joined = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    commit = F.coalesce("commit", F.lit(0)).cast("double")
    out = joined.select(
        F.col("o_orderkey").alias("run_id"), F.col("c_mktsegment").alias("chain"), F.col("o_orderpriority").alias("topology"), F.col("r_name").alias("workload"), F.col("o_orderstatus").alias("size"),
        F.concat_ws("|", "c_mktsegment", "o_orderpriority", "r_name", "o_orderstatus", F.year("o_orderdate").cast("string")).alias("batch"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("ts"), F.coalesce("submit", F.lit(0)).cast("double").alias("submit"), commit.alias("commit"),
        (F.floor(commit / 10) / 10).cast("double").alias("tps"),
        F.when(F.col("n_done") > 0, F.col("ship_days") / F.col("n_done") - F.datediff("o_orderdate", F.lit("1970-01-01"))).alias("latency"),
        F.col("c_acctbal").cast("double").alias("energy"), F.col("o_totalprice").cast("double").alias("load"), F.col("rx").cast("double").alias("rx"), F.col("tx").cast("double").alias("tx"),
    )
    return out.withColumn("run", F.row_number().over(W.partitionBy("batch").orderBy("ts", "run_id")))


def outcome_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive_outcomes(runs(spark, sf_dir))
