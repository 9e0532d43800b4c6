"""Sampling, partition control, caching and label rules ahead of a workload."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runcast.functions.draws import digest, uniform
from runcast.session import input_bytes, materialize

PARTITION_BYTES = 128 * 1024 * 1024


def sample_rows(df: DataFrame, fraction: float, seed: int = 17) -> DataFrame:
    """Bernoulli sample without replacement. Always seeded: the same input gives the same rows."""
    return df.sample(withReplacement=False, fraction=fraction, seed=seed)


def sample_by_key(df: DataFrame, key: Column, fraction: float, seed: int = 17) -> DataFrame:
    """Bernoulli sample decided by the key alone, so that any partitioning keeps the same rows."""
    return df.where(uniform(digest(seed, key)) < F.lit(float(fraction)))


def partitions_for(df: DataFrame, bytes_each: int = PARTITION_BYTES) -> int:
    """How many partitions of about ``bytes_each`` the input's files make, by the sizes Spark knows; one per core at least.

    What is sampled or left out later has to be read all the same, so that the files count whole.
    """
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-input_bytes(df) // bytes_each))


def at_most_partitions(df: DataFrame, count: int | None = None) -> DataFrame:
    """Merge to at most ``count`` partitions (by size if not given); never moves rows to raise the number."""
    return df.coalesce(partitions_for(df) if count is None else count)


def exactly_partitions(df: DataFrame, count: int | None = None) -> DataFrame:
    """Spread over ``count`` partitions (by size if not given; a shuffle)."""
    return df.repartition(partitions_for(df) if count is None else count)


def load_into_cache(df: DataFrame) -> tuple[DataFrame, int]:
    """Keep the rows in memory (disk beyond it), force them, and return them with their count."""
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    return kept, kept.count()


def prepare(df: DataFrame, fraction: float, partitions: int | None = None, seed: int = 17) -> DataFrame:
    """What every workload does to its input: sample, then merge partitions (as many as its size asks for by default)."""
    return at_most_partitions(sample_rows(df, fraction, seed), partitions)


def remap_label(label: Column, old: float, new: float) -> Column:
    """``new`` where the label is ``old``, else the label."""
    return F.when(label == F.lit(old), F.lit(new)).otherwise(label)


def zero_one_label(label: Column) -> Column:
    """-1/+1 labels as 0/1, which classifiers require."""
    return remap_label(label.cast("double"), -1.0, 0.0)


def soft_label(label: Column) -> Column:
    """0.5 for labels up to 0, 0.9 from 1 on, else the label."""
    return F.when(label <= 0, F.lit(0.5)).when(label >= 1, F.lit(0.9)).otherwise(label)


def positive_label(df: DataFrame, label: str = "label") -> DataFrame:
    return df.where(F.col(label) > 0)


def sorted_ranges(df: DataFrame, *key: str) -> DataFrame:
    """Total order over partitions: range partitioning, then a sort inside each; as many ranges as shuffles have."""
    return df.repartitionByRange(*key).sortWithinPartitions(*key)


def with_positions(ordered: DataFrame, name: str = "position") -> DataFrame:
    """Number the rows of a totally ordered frame from 0, as they stand: place in the partition plus what is before.

    The ordered rows are written once, so both passes see the same partitions; the counts are one row per partition.
    """
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = materialize(ordered.select("*", F.spark_partition_id().alias("_part"), within.alias("_at")), "ordered")
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop(
        "_part", "_at", "_before")
