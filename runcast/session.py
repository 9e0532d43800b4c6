"""Session settings, the shared scratch folder and cut-points for long lineages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# a table goes to every executor only if its files are smaller than this
BROADCAST_BYTES = 32 * 1024 * 1024
# whole texts go to Python in batches of about this size
BATCH_BYTES = 4 * 1024 * 1024


def build_session(app_name: str = "runcast", **conf: str) -> SparkSession:
    """A session with the settings the operators are written for; ``conf`` wins over the defaults."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # split a hot key of a join even if the plan then needs one more exchange
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    builder = SparkSession.builder.appName(app_name)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; where that is unset, one in the warehouse.

    On a cluster a warehouse in a machine's own files is refused: executors could not see each other's tables.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    alone = spark.sparkContext.master.split("[")[0] == "local"
    if not alone and warehouse.partition(":")[0] in ("file", warehouse):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share; {warehouse} is a machine's own")
    return f"{warehouse}/_scratch"


_handed_out: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the scratch folder."""
    path = f"{scratch_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _handed_out.append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Delete the scratch tables this process has made, and count them; frames that read them end with that."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    deleted = 0
    while _handed_out:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_handed_out.pop())
        deleted += bool(path.getFileSystem(conf).delete(path, True))
    return deleted


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: the lineage ends here."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_bytes(table: DataFrame) -> int:
    """Size on disk of the files behind a frame that reads them unchanged."""
    return int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def input_bytes(df: DataFrame) -> int:
    """Size of all that a frame is read from: files, rows in memory."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df`` itself, ahead of Python work on whole texts: a batch of its session has about BATCH_BYTES, or one longer row.

    10,000 rows, Spark's own limit, can be tens of MB of text, which JVM and worker of every running task hold beside
    the heap, some of it twice. A limit in bytes that the session has been given stays.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, None) is None:
        conf.set(key, str(BATCH_BYTES))
    return df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """At least one partition per core (of the given keys, if any), ahead of work that costs far more than moving rows.

    Never fewer than shuffles have, so partitions do not grow with the data. The number is explicit because
    adaptive execution would merge small partitions again.
    """
    spark = df.sparkSession
    count = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(count, *keys)
