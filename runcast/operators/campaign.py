"""Campaign tables: which clusters to run, their sizes and names, repeats and companions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPEATS = 3


def plan_rows(campaigns: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per instance type, algorithm and design of each campaign."""
    rows = campaigns.withColumn("instance", F.explode("instance_type"))
    rows = rows.withColumn("algo", F.explode("algorithm")).withColumn("plan", F.explode("design"))
    return rows.select(
        *keys, F.col("instance.name").alias("instance_type"), F.col("instance.cores").alias("cores_per_instance"),
        F.col("algo.name").alias("algorithm"), F.col("algo.program").alias("program"),
        F.col("algo.dataset").alias("dataset"), F.col("plan.cores").alias("cores"),
        F.col("plan.partition").alias("fraction"))


def instances(cores: Column, cores_per_instance: Column) -> Column:
    """Whole worker instances for the cores, and one master."""
    return (cores / cores_per_instance).cast("int") + 1


def _number(value: Column) -> Column:
    """Whole numbers without a decimal point, small ones without an exponent."""
    plain = F.regexp_replace(F.format_string("%.12f", value.cast("double")), "0+$", "")
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(plain)


def run_name(instance_type: Column, cores_per_instance: Column, cores: Column, algorithm: Column,
             fraction: Column, dataset: Column) -> Column:
    """``TYPE-CORES-NUM-ALGO-PART-DATASET``; CORES and NUM count the master, as decimals."""
    number = cores / cores_per_instance + 1.0
    all_cores = cores_per_instance * number
    return F.concat_ws("-", instance_type, all_cores.cast("double").cast("string"),
                       number.cast("double").cast("string"), algorithm, _number(fraction),
                       F.element_at(F.split(dataset, "/"), -1))


def sized_plan(plan: DataFrame) -> DataFrame:
    """Add the instance count and the run name."""
    name = run_name(F.col("instance_type"), F.col("cores_per_instance"), F.col("cores"), F.col("algorithm"),
                    F.col("fraction"), F.col("dataset"))
    return plan.withColumns({"instances": instances(F.col("cores"), F.col("cores_per_instance")), "name": name})


def with_full_runs(plan: DataFrame) -> DataFrame:
    """Add a full-input companion to every sampled row: each once, and none that the plan already has.

    One pass: every row and its companion are counted together, and grouping takes nulls as equal. A row
    without a fraction has no companion.
    """
    others = [c for c in plan.columns if c != "fraction"]
    own = F.struct(F.col("fraction"), F.lit(1).alias("own"))
    full = F.struct(F.lit(1.0).alias("fraction"), F.lit(0).alias("own"))
    paired = plan.select(*others, F.inline(F.when(F.col("fraction") != 1, F.array(own, full)).otherwise(F.array(own))))
    counted = paired.groupBy(*plan.columns).agg(F.greatest(F.sum("own"), F.lit(1)).alias("_rows"))
    return counted.select(*plan.columns, F.explode(F.sequence(F.lit(1), F.col("_rows").cast("int"))).alias("_row")).drop("_row")


def repeated(plan: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """Every row ``repeats`` times, numbered from 1."""
    return plan.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
