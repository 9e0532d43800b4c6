"""Mean times of repeated runs, kept up to date as run logs arrive.

New log files are read by a file source and summed per configuration; the sums are the state of the stream, one
row per configuration however many runs it has. Every micro-batch writes the configurations it has changed
into a folder of its own, named by the batch, and replaces that folder if the batch is run again. So a
restart from the checkpoint, also in the midst of a batch, counts no file twice and loses none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from runcast.sources import runlogs

KEYS = ("cores", "fraction", "script")
_SUMS = "cores int, fraction double, script string, total double, repeats long"


def changed_sums(lines: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Sum and number of times per configuration from log lines ``(name, value)``, batch or stream."""
    samples = runlogs.parse_run_logs(lines)
    return samples.groupBy(*keys).agg(F.sum("time").alias("total"), F.count("time").alias("repeats"))


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Stream of ``(name, value)`` from all log files below ``path``, also in folders ``run=<name>``."""
    lines = spark.readStream.option("recursiveFileLookup", "true").text(path)
    return lines.select(runlogs.file_name(F.col("_metadata.file_path")).alias("name"), "value")


def write_batch(sums: DataFrame, batch: int, sink: str) -> None:
    """The changed configurations of one batch; a second run of the batch replaces the first."""
    sums.write.mode("overwrite").parquet(f"{sink}/batch={batch}")


def update_means(spark: SparkSession, logs: str, sink: str, checkpoint: str, keys: Sequence[str] = KEYS) -> None:
    """Take in all log files that have arrived since the last call with the same ``checkpoint``, and return.

    ``sink`` and ``checkpoint`` are folders that all executors share. Files already seen are not read again,
    so a log that grows must get its new lines as a new file.
    """
    stream = changed_sums(log_lines(spark, logs), keys).writeStream.outputMode("update").foreachBatch(
        lambda sums, batch: write_batch(sums, batch, sink))
    stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_means(spark: SparkSession, sink: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Keys, mean time and number of repeats as of the last batch; no rows before the first one."""
    schema = StructType.fromDDL(f"{_SUMS}, batch long")
    schema = StructType([f for f in schema.fields if f.name in (*keys, "total", "repeats", "batch")])
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sink)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema).select(*keys, F.col("total").alias("time"), "repeats")
    told = spark.read.schema(schema).parquet(sink)
    last = told.groupBy(*keys).agg(F.max_by(F.struct("total", "repeats"), "batch").alias("last"))
    return last.select(*keys, (F.col("last.total") / F.col("last.repeats")).alias("time"), "last.repeats")


def compact(spark: SparkSession, sink: str, compacted: str, keys: Sequence[str] = KEYS) -> None:
    """Write the last state of every configuration to a new sink, as its batch 0.

    For a sink of many batches, between two updates. Later updates go on with the old checkpoint and the new
    sink, since their batches have higher numbers.
    """
    told = spark.read.parquet(sink)
    last = told.groupBy(*keys).agg(F.max_by(F.struct("total", "repeats"), "batch").alias("last"))
    write_batch(last.select(*keys, "last.total", "last.repeats"), 0, compacted)
