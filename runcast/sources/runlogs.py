"""Run samples, run logs, cluster lists and campaign files: text to rows.

Parsers take DataFrames, readers take paths. A line that does not parse gives
no row; it is never counted as a time of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed formats
TIME_MARK = "time:"
COMMENT_MARK = "&"
LOG_NAME = r"^(\d+)-([0-9.]+)-(.+)$"
RUN_NAME = r"^([^-]+)-([0-9.]+)-([0-9.]+)-([^-]+)-([0-9.]+)-(.+)$"
CAMPAIGN_SCHEMA = (
    "instance_type array<struct<name:string,cores:int>>, "
    "algorithm array<struct<name:string,program:string,dataset:string>>, "
    "design array<struct<cores:int,partition:double>>"
)


def parse_run_samples(lines: DataFrame) -> DataFrame:
    """``cores,machine,fraction,time`` lines: only text before the first space counts, ``&`` lines are comments."""
    field = F.split(F.split("value", " ")[0], ",")
    rows = lines.where(~F.col("value").startswith(COMMENT_MARK)).select(
        F.get(field, F.lit(0)).try_cast("int").alias("cores"), F.get(field, F.lit(1)).try_cast("int").alias("machine"),
        F.get(field, F.lit(2)).try_cast("double").alias("fraction"),
        F.get(field, F.lit(3)).try_cast("double").alias("time"))
    return rows.dropna()


def read_run_samples(spark: SparkSession, path: str) -> DataFrame:
    return parse_run_samples(spark.read.text(path))


def _decoded(path: Column) -> Column:
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def file_name(path: Column) -> Column:
    """The last part of a path; a file in a folder ``run=<name>`` is named by that folder.

    Paths come encoded, and names of folders were encoded once more when they were written.
    """
    folder = F.regexp_extract(path, r"/run=([^/]+)/[^/]*$", 1)
    return F.when(folder != "", _decoded(_decoded(folder))).otherwise(_decoded(F.element_at(F.split(path, "/"), -1)))


def log_key(name: Column) -> list[Column]:
    """cores, fraction and script from ``<cores>-<fraction>-<script>``."""
    return [F.regexp_extract(name, LOG_NAME, 1).try_cast("int").alias("cores"),
            F.regexp_extract(name, LOG_NAME, 2).try_cast("double").alias("fraction"),
            F.regexp_extract(name, LOG_NAME, 3).alias("script")]


def _second_field(line: Column) -> Column:
    return F.trim(F.get(F.split(line, ":"), F.lit(1))).try_cast("double")


def parse_run_logs(lines: DataFrame) -> DataFrame:
    """``time:`` lines of ``(name, value)`` rows to ``(cores, fraction, script, time)``."""
    timed = lines.where(F.col("value").contains(TIME_MARK))
    return timed.select(*log_key(F.col("name")), _second_field(F.col("value")).alias("time")).dropna()


def read_run_logs(spark: SparkSession, path: str) -> DataFrame:
    """Run logs named by their configuration, repeated runs appended line by line."""
    lines = spark.read.text(path).select(file_name(F.col("_metadata.file_path")).alias("name"), "value")
    return parse_run_logs(lines)


def parse_container_logs(first_lines: DataFrame) -> DataFrame:
    """First line of each log ``(name, value)`` to ``(name, time)``."""
    return first_lines.select("name", _second_field(F.col("value")).alias("time")).dropna()


def first_lines(lines: DataFrame) -> DataFrame:
    """The first line of each file: ``(name, value)`` of ``(name, path, block, value)`` rows in reading order.

    A task keeps one line per file, so a log of any length costs no memory.
    """
    placed = lines.withColumn("at", F.monotonically_increasing_id())
    firsts = placed.groupBy("path").agg(F.min_by("value", F.struct("block", "at")).alias("value"),
                                        F.first("name").alias("name"))
    return firsts.select("name", "value")


def read_container_logs(spark: SparkSession, path: str) -> DataFrame:
    """Gzip container logs ``<run name>-stdout.gz``; the time is in the first line."""
    path_column = F.col("_metadata.file_path")
    lines = spark.read.text(path).select(
        F.regexp_replace(file_name(path_column), r"-stdout(\.gz)?$", "").alias("name"), path_column.alias("path"),
        F.col("_metadata.file_block_start").alias("block"), "value")
    return parse_container_logs(first_lines(lines))


def parse_result_files(lines: DataFrame) -> DataFrame:
    """One number per ``(name, value)`` row: ``(name, time)``."""
    return lines.select("name", F.trim("value").try_cast("double").alias("time")).dropna()


def read_result_files(spark: SparkSession, path: str) -> DataFrame:
    """Files that hold one number each, named by their run."""
    return parse_result_files(spark.read.text(path).select(
        file_name(F.col("_metadata.file_path")).alias("name"), "value"))


def parse_run_names(runs: DataFrame, name: str = "name") -> DataFrame:
    """Add the parts of ``TYPE-CORES-NUM-ALGO-PART-DATASET``; CORES and NUM include the master.

    ``worker_cores`` leaves the master out: cores per instance times (NUM - 1).
    """
    def part(place: int) -> Column:
        return F.regexp_extract(name, RUN_NAME, place)

    parsed = runs.withColumns({
        "instance_type": part(1), "cores": part(2).try_cast("double"), "instances": part(3).try_cast("double"),
        "algorithm": part(4), "fraction": part(5).try_cast("double"), "dataset": part(6)})
    per_instance = F.col("cores") / F.nullif(F.col("instances"), F.lit(0.0))
    return parsed.where(F.col("instances").isNotNull()).withColumn(
        "worker_cores", per_instance * (F.col("instances") - 1))


def parse_cluster_list(lines: DataFrame) -> DataFrame:
    """``name id`` lines, any white space between."""
    field = F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\s+")
    return lines.where(F.size(field) >= 2).select(field[0].alias("name"), field[1].alias("cluster_id"))


def read_cluster_list(spark: SparkSession, path: str) -> DataFrame:
    return parse_cluster_list(spark.read.text(path))


def parse_campaigns(lines: DataFrame) -> DataFrame:
    """Campaign JSON held in a ``value`` column; other columns stay."""
    others = [c for c in lines.columns if c != "value"]
    return lines.select(*others, F.from_json("value", CAMPAIGN_SCHEMA).alias("c")).select(*others, "c.*")


def read_campaigns(spark: SparkSession, path: str, *, keys: str = "", by_line: bool = False) -> DataFrame:
    """One campaign per JSON file, or per line; ``keys`` are further fields, as ``name type, ..``."""
    schema = f"{keys}, {CAMPAIGN_SCHEMA}" if keys else CAMPAIGN_SCHEMA
    return spark.read.schema(schema).option("multiLine", not by_line).json(path)
