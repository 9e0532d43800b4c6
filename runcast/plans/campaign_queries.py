"""Queries on logs, run names and campaign plans; the text is derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runcast.operators import campaign, stats
from runcast.plans import views
from runcast.plans.registry import query
from runcast.session import scratch_path
from runcast.sources import runlogs, sinks
from runcast.streaming import averages

# one log line per event: errors print something else, views print the word only
_CORES = "CAST(2 * (1 + user_id % 8) AS INTEGER)"
_LOGGED = "FROM events WHERE event_type NOT IN ('error', 'view')"


def _log_lines(events: DataFrame) -> DataFrame:
    """(run, value): a line per event in the log of its configuration and script."""
    cores = (2 * (1 + F.col("user_id") % 8)).cast("int")
    name = F.concat(F.concat_ws("-", cores.cast("string"), (1 / (1 + F.col("user_id") % 4)).cast("string"),
                                F.col("event_type")), F.lit(".py"))
    line = (F.when(F.col("event_type") == "error", F.concat(F.lit("lost executor "), F.col("value")))
            .when(F.col("event_type") == "view", F.lit("time: none"))
            .otherwise(F.concat(F.lit("time: "), F.col("value"))))
    return events.select(name.alias("run"), line.alias("value"))


def _run_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples read back from log files, one folder per configuration and script."""
    path = scratch_path(spark, "run-logs")
    sinks.write_run_texts(_log_lines(views.table(spark, sf_dir, "events")), path)
    return runlogs.read_run_logs(spark, path)


_LOG_MEANS = f"""SELECT {_CORES} AS cores, round(CAST(1 AS DOUBLE) / (1 + user_id % 4), 9) AS fraction,
       event_type || '.py' AS script, count(*) AS repeats, round(avg(value), 6) AS time
{_LOGGED} GROUP BY ALL"""


@query("run_log_means", _LOG_MEANS)
def run_log_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = stats.mean_times(_run_logs(spark, sf_dir), ["cores", "fraction", "script"])
    return means.withColumns({"time": F.round("time", 6), "fraction": F.round("fraction", 9)})


@query("streamed_run_means", _LOG_MEANS)
def streamed_run_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logs arrive in three portions, each taken in by a stream that starts anew from its checkpoint."""
    events = views.table(spark, sf_dir, "events")
    logs, sink, checkpoint = (scratch_path(spark, label) for label in ("arriving-logs", "running-means", "means-checkpoint"))
    for portion in range(3):
        sinks.write_run_texts(_log_lines(events.where(F.col("event_id") % 3 == portion)), f"{logs}/{portion}")
        averages.update_means(spark, logs, sink, checkpoint)
    means = averages.read_means(spark, sink)
    return means.withColumns({"time": F.round("time", 6), "fraction": F.round("fraction", 9)})


@query("appended_results", f"""SELECT {_CORES} AS cores, round(CAST(1 AS DOUBLE) / (1 + user_id % 4), 9) AS fraction,
       round(avg(value), 6) AS time, CAST(2 AS BIGINT) AS lines
{_LOGGED} GROUP BY ALL""")
def appended_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averaged results appended twice to the same CSV folder: every line is there twice."""
    path = scratch_path(spark, "results")
    means = stats.mean_times(_run_logs(spark, sf_dir), ["cores", "fraction"])
    for _ in range(2):
        sinks.append_results(means, path)
    read = spark.read.schema("cores int, fraction double, time double").csv(path)
    return read.groupBy("cores", F.round("fraction", 9).alias("fraction"), F.round("time", 6).alias("time")).agg(
        F.count(F.lit(1)).alias("lines"))


@query("container_log_times", """SELECT 'nation ' || CAST(c_nationkey AS VARCHAR) AS name, arg_min(c_acctbal, c_custkey) AS time
FROM customer GROUP BY c_nationkey HAVING min(c_custkey) % 4 <> 1""")
def container_log_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gzip logs of many lines, of which only the first counts; some logs begin with something else."""
    other = F.when(F.col("c_custkey") % 4 == 1, F.lit("lost executor"))
    line = F.coalesce(other, F.concat(F.lit("time: "), F.col("c_acctbal"), F.lit(" ")))
    customers = views.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("nation "), F.col("c_nationkey")).alias("run"), "c_custkey", line.alias("value"))
    path = scratch_path(spark, "container-logs")
    sinks.write_run_texts(customers, path, ["c_custkey"], compression="gzip")
    return runlogs.read_container_logs(spark, path)


@query("result_file_times", """SELECT o_orderpriority || ' ' || o_orderstatus AS name, max(o_totalprice) AS time
FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL""")
def result_file_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One number per file, blanks around it; files without a number give no row."""
    largest = views.table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(
        F.max("o_totalprice").alias("most"))
    content = F.when(F.col("o_orderstatus") == "P", "killed").otherwise(F.concat(F.lit(" "), F.col("most"), F.lit(" ")))
    path = scratch_path(spark, "results")
    sinks.write_run_texts(largest.select(F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("run"),
                                         content.alias("value")), path)
    return runlogs.read_result_files(spark, path)


_NAMES = """SELECT s_suppkey, 2 + s_suppkey % 3 * 2 AS per, 2 + s_suppkey % 7 AS num,
  'type' || CAST(s_nationkey AS VARCHAR) AS instance_type,
  s_name AS algorithm,
  CASE WHEN s_suppkey % 5 = 0 THEN '1' ELSE '0.0' || CAST(11 + s_suppkey % 80 AS VARCHAR) END AS part,
  'set-' || CAST(s_nationkey AS VARCHAR) || '.binary' AS dataset FROM supplier"""


@query("run_name_parse", f"""SELECT s_suppkey, instance_type, CAST(per * num AS DOUBLE) AS cores,
  CAST(num AS DOUBLE) AS instances, algorithm, CAST(part AS DOUBLE) AS fraction, dataset,
  CAST(per * (num - 1) AS DOUBLE) AS worker_cores FROM ({_NAMES}) t""")
def run_name_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    per, number = 2 + key % 3 * 2, 2 + key % 7
    name = F.concat_ws(
        "-", F.concat(F.lit("type"), F.col("s_nationkey")), (per * number).cast("double").cast("string"),
        number.cast("double").cast("string"), F.col("s_name"),
        F.when(key % 5 == 0, "1").otherwise(F.concat(F.lit("0.0"), (11 + key % 80).cast("string"))),
        F.concat(F.lit("set-"), F.col("s_nationkey"), F.lit(".binary")))
    named = views.table(spark, sf_dir, "supplier").select("s_suppkey", name.alias("name"))
    return runlogs.parse_run_names(named).drop("name")


@query("cluster_list", """SELECT c_name AS name, 'j-' || CAST(c_custkey AS VARCHAR) AS cluster_id FROM customer
WHERE c_custkey % 10 <> 0""")
def cluster_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists with uneven white space; a line without an id gives no row."""
    ident = F.when(F.col("c_custkey") % 10 != 0, F.concat(F.lit("j-"), F.col("c_custkey"))).otherwise(F.lit(""))
    lines = views.table(spark, sf_dir, "customer").select(F.concat(F.col("c_name"), F.lit(" \t "), ident).alias("value"))
    path = scratch_path(spark, "cluster-list")
    lines.write.text(path)
    return runlogs.read_cluster_list(spark, path)


_CAMPAIGNS = """campaigns AS (SELECT c_custkey, c_mktsegment, c_nationkey, 2 + c_custkey % 3 * 2 AS per,
  8 + c_custkey % 5 * 4 AS cores, (1 + c_custkey % 9) / CAST(10 AS DOUBLE) AS share FROM customer),
plans AS (
  SELECT c_custkey, i.instance_type, CAST(per * i.factor AS INTEGER) AS cores_per_instance, algorithm,
         lower(algorithm) || '.py' AS program, 'data/' || c_mktsegment || '.parquet' AS dataset,
         CAST(c.cores * d.factor AS INTEGER) AS cores, CASE WHEN d.factor = 1 THEN share ELSE CAST(1 AS DOUBLE) END AS fraction
  FROM (SELECT *, unnest([c_mktsegment, 'NATION_' || CAST(c_nationkey AS VARCHAR)]) AS algorithm FROM campaigns) c
  CROSS JOIN (VALUES ('narrow', 1), ('wide', 2)) i(instance_type, factor)
  CROSS JOIN (VALUES (1), (2), (4)) d(factor))"""


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plan rows of one campaign per customer, read from JSON lines."""
    key, segment = F.col("c_custkey"), F.col("c_mktsegment")
    nation = F.concat(F.lit("NATION_"), F.col("c_nationkey"))

    def algorithm(name: Column) -> Column:
        return F.struct(name.alias("name"), F.concat(F.lower(name), F.lit(".py")).alias("program"),
                        F.concat(F.lit("data/"), segment, F.lit(".parquet")).alias("dataset"))

    def instance(name: str, factor: int) -> Column:
        return F.struct(F.lit(name).alias("name"), (factor * (2 + key % 3 * 2)).alias("cores"))

    def design(factor: int, share: Column) -> Column:
        return F.struct((factor * (8 + key % 5 * 4)).alias("cores"), share.alias("partition"))

    text = F.to_json(F.struct(
        key, F.array(instance("narrow", 1), instance("wide", 2)).alias("instance_type"),
        F.array(algorithm(segment), algorithm(nation)).alias("algorithm"),
        F.array(design(1, (1 + key % 9) / F.lit(10.0)), design(2, F.lit(1.0)), design(4, F.lit(1.0))).alias("design")))
    path = scratch_path(spark, "campaigns")
    views.table(spark, sf_dir, "customer").select(text.alias("value")).write.text(path)
    campaigns = runlogs.read_campaigns(spark, path, keys="c_custkey bigint", by_line=True)
    return campaign.plan_rows(campaigns, ["c_custkey"])


_PLAN_COLUMNS = "c_custkey, instance_type, cores_per_instance, algorithm, program, dataset, cores, fraction"


@query("plan_fanout", f"WITH {_CAMPAIGNS} SELECT {_PLAN_COLUMNS} FROM plans")
def plan_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir)


@query("cluster_sizes", f"""WITH {_CAMPAIGNS}
SELECT c_custkey, instance_type, algorithm, cores, fraction,
       CAST(trunc(cores / CAST(cores_per_instance AS DOUBLE)) AS INTEGER) + 1 AS instances,
       instance_type || '-' || CAST(cores_per_instance * (cores / CAST(cores_per_instance AS DOUBLE) + 1) AS VARCHAR) || '-'
         || CAST(cores / CAST(cores_per_instance AS DOUBLE) + 1 AS VARCHAR) || '-' || algorithm || '-'
         || CASE WHEN fraction = 1 THEN '1' ELSE CAST(fraction AS VARCHAR) END || '-' || substr(dataset, 6) AS name
FROM plans""")
def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = campaign.sized_plan(_plan(spark, sf_dir))
    return sized.select("c_custkey", "instance_type", "algorithm", "cores", "fraction", "instances", "name")


_GAPPED = "SELECT * REPLACE (nullif(dataset, 'data/BUILDING.parquet') AS dataset) FROM plans"


@query("companion_runs", f"""WITH {_CAMPAIGNS}, gapped AS ({_GAPPED})
SELECT {_PLAN_COLUMNS} FROM gapped
UNION ALL SELECT * FROM (
  SELECT {_PLAN_COLUMNS.replace('fraction', 'CAST(1 AS DOUBLE) AS fraction')} FROM gapped WHERE fraction <> 1
  EXCEPT SELECT {_PLAN_COLUMNS} FROM gapped) t""")
def companion_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companions of a plan in which some rows have no dataset."""
    plan = _plan(spark, sf_dir)
    return campaign.with_full_runs(plan.withColumn("dataset", F.nullif("dataset", F.lit("data/BUILDING.parquet"))))


@query("repeated_plan", f"""WITH {_CAMPAIGNS}
SELECT c_custkey, instance_type, algorithm, cores, fraction, CAST(repeat AS INTEGER) AS repeat
FROM plans CROSS JOIN (SELECT unnest(range(1, 4)) AS repeat) r""")
def repeated_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    repeated = campaign.repeated(_plan(spark, sf_dir))
    return repeated.select("c_custkey", "instance_type", "algorithm", "cores", "fraction", "repeat")
