"""Run samples, design problems and other inputs of the engine, derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dated_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run sample per line item and the day it ran; the planted time model is known."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("workload"),
        (F.col("l_linenumber") % 3).cast("int").alias("instance_type"),
        (1 + F.col("l_suppkey") % 16).cast("double").alias("machine"),
        ((1 + F.col("l_partkey") % 64).cast("double") / 64).alias("fraction"), "l_discount",
        F.col("l_shipdate").cast("date").alias("day"))
    cores = 2 * F.col("machine")
    time = (F.lit(5.0) + 40 * F.col("fraction") / cores + F.lit(0.3) * F.col("machine")
            + 2 * F.ln("machine") + F.col("l_discount"))
    return lines.select("l_orderkey", "l_linenumber", "workload", "instance_type", "machine",
                        cores.alias("cores"), "fraction", time.alias("time"), "day")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run samples without their days."""
    return dated_runs(spark, sf_dir).drop("day")


def design_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One experiment design problem per part."""
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("workload"),
        F.lit(3).alias("min_parts"), (20 + size % 4 * 6).cast("int").alias("max_parts"),
        F.lit(256).alias("total_parts"), F.lit(1).alias("min_machines"),
        (6 + size % 5).cast("int").alias("max_machines"), F.lit(2).alias("cores_per_machine"),
        (F.lit(5.0) + 5 * (size % 3)).alias("budget"), F.lit(16).alias("steps"))
