"""Queries on sources, sinks, generators and input preparation."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runcast.functions.draws import LEHMER_MODULUS, LEHMER_MULTIPLIERS
from runcast.functions.features import MODEL_TERMS
from runcast.operators import prepare, timemodel
from runcast.plans import model_queries, sqltext, views
from runcast.plans.registry import query
from runcast.session import scratch_path, spread
from runcast.sources import mldata, runlogs, sinks, synthetic

_LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def line_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = views.table(spark, sf_dir, "lineitem")
    return mldata.assemble(lines.withColumn("label", F.col("l_linenumber").cast("double")), _LINE_NUMBERS, "label")


def line_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all line items, spread evenly: making a row costs far more than moving an id."""
    lines = views.table(spark, sf_dir, "lineitem")
    ids = lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    return spread(ids)


@query("libsvm_round_trip", f"""SELECT l_linenumber AS label, count(*) AS n,
  {', '.join(f'round(avg({c}), 6) AS mean_{i}' for i, c in enumerate(_LINE_NUMBERS))}
FROM lineitem GROUP BY l_linenumber""")
def libsvm_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "libsvm")
    mldata.write_libsvm(line_vectors(spark, sf_dir), path)
    values = vector_to_array("features")
    read = mldata.read_libsvm(spark, path, features=len(_LINE_NUMBERS))
    return read.groupBy(F.col("label").cast("int").alias("label")).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.round(F.avg(F.get(values, i)), 6).alias(f"mean_{i}") for i in range(len(_LINE_NUMBERS))])


@query("run_sample_round_trip", f"""WITH {sqltext.RUNS}
SELECT CAST(cores AS INTEGER) AS cores, CAST(machine AS INTEGER) AS machine, count(*) AS n,
       round(avg(fraction), 8) AS fraction, round(avg(time), 6) AS time
FROM runs GROUP BY cores, machine""")
def run_sample_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples written as text with trailing words and comment lines between, then parsed."""
    path = scratch_path(spark, "run-samples")
    runs = views.runs(spark, sf_dir)
    line = F.concat_ws(",", F.col("cores").cast("int"), F.col("machine").cast("int"), "fraction", "time")
    comment = F.concat(F.lit("&,"), line)
    lines = runs.select(F.explode(F.array(F.concat(line, F.lit(" measured")), comment)).alias("value"))
    lines.write.text(path)
    return runlogs.read_run_samples(spark, path).groupBy("cores", "machine").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("fraction"), 8).alias("fraction"),
        F.round(F.avg("time"), 6).alias("time"))


# the OLS mask of each group, as in the query of that name, then sums over what it keeps
@query("feature_csv_round_trip", f"""{model_queries.MASKED}
SELECT workload, instance_type, count(*) AS n, round(avg(time), 6) AS time,
  {', '.join(f'round(avg(CASE WHEN k_{i} THEN z{i} ELSE 0 END), 8) AS z{i}' for i in range(1, 6))}, round(sum(z0), 1) AS z0
FROM features JOIN masks USING (workload, instance_type) GROUP BY workload, instance_type""")
def feature_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features with the dropped terms of their group as 0, written with the group keys and read back."""
    keys = ["workload", "instance_type"]
    path = scratch_path(spark, "features")
    features = timemodel.model_features(views.runs(spark, sf_dir), keys)
    masks = timemodel.with_mask(timemodel.with_ols(timemodel.gram_sums(features, keys)))
    sinks.write_features(timemodel.selected_features(features, masks, keys), path, keys)
    schema = ", ".join(["workload string", "instance_type int", *[f"{c} double" for c in ["time", *MODEL_TERMS]]])
    return mldata.read_csv(spark, path, schema).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("time"), 6).alias("time"),
        *[F.round(F.avg(z), 8).alias(z) for z in MODEL_TERMS[1:]], F.round(F.sum("z0"), 1).alias("z0"))


@query("parquet_round_trip", """SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity
FROM lineitem GROUP BY l_returnflag""")
def parquet_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "parquet")
    mldata.write_parquet(views.table(spark, sf_dir, "lineitem"), path)
    return mldata.read_parquet(spark, path).groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("seeded_sample", """SELECT count(*) AS rows_in_table, TRUE AS within_table, TRUE AS repeatable, TRUE AS expected_size
FROM lineitem""")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample holds rows of the table, is the same again, and its size is within five standard deviations."""
    lines = views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    columns = lines.columns

    def told(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(*columns, *[F.lit(int(name == other)).alias(other) for other in ("table", "once", "again")])

    every = told(lines, "table")
    for name in ("once", "again"):
        every = every.union(told(prepare.prepare(lines, 0.1), name))
    each = every.groupBy(*columns).agg(*[F.sum(name).alias(name) for name in ("table", "once", "again")])
    total, drawn = F.sum("table"), F.sum("once")
    return each.agg(
        total.alias("rows_in_table"), F.bool_and(F.col("once") <= F.col("table")).alias("within_table"),
        F.bool_and(F.col("once") == F.col("again")).alias("repeatable"),
        (F.abs(drawn - 0.1 * total) <= 5 * F.sqrt(total * 0.1 * 0.9)).alias("expected_size"))


_BOUND = 0.25 * 2 ** 32 - 0.5


@query("hash_sample", f"""SELECT o_orderkey, o_totalprice FROM orders
WHERE CAST('0x' || substr(md5('17:' || CAST(o_orderkey AS VARCHAR) || ':0'), 1, 8) AS BIGINT) < {_BOUND}""")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = views.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return prepare.sample_by_key(orders, F.col("o_orderkey"), 0.25)


@query("cached_input_rows", """SELECT count(*) AS rows_cached, count(*) AS rows_spread FROM lineitem""")
def cached_input_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, rows = prepare.load_into_cache(
        prepare.at_most_partitions(views.table(spark, sf_dir, "lineitem").select("l_orderkey")))
    spread = prepare.exactly_partitions(kept).agg(F.count(F.lit(1)).alias("rows_spread"))
    result = spread.select(F.lit(rows).cast("bigint").alias("rows_cached"), "rows_spread").first()
    kept.unpersist()
    return spark.createDataFrame([tuple(result)], "rows_cached bigint, rows_spread bigint")


# labels -1 and 1 as classification data carries them
_SIGNED = "SELECT c_custkey, CASE WHEN c_acctbal < 5000 THEN CAST(-1 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS label FROM customer"


@query("label_remap", f"""SELECT c_custkey, label, CASE WHEN label = -1 THEN CAST(1 AS DOUBLE) ELSE label END AS merged,
  CASE WHEN label = -1 THEN CAST(0 AS DOUBLE) ELSE label END AS zero_one,
  CAST(CASE WHEN label <= 0 THEN 0.5 WHEN label >= 1 THEN 0.9 ELSE label END AS DOUBLE) AS soft
FROM ({_SIGNED}) t""")
def label_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label")
    return _signed(spark, sf_dir).select("c_custkey", "label", prepare.remap_label(label, -1.0, 1.0).alias("merged"),
                                         prepare.zero_one_label(label).alias("zero_one"),
                                         prepare.soft_label(label).alias("soft"))


def _signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    balance = F.col("c_acctbal")
    return views.table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(balance < 5000, F.lit(-1.0)).otherwise(F.lit(1.0)).alias("label"))


@query("positive_labels", f"SELECT c_custkey, label FROM ({_SIGNED}) t WHERE label > 0")
def positive_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.positive_label(_signed(spark, sf_dir))


@query("sorted_orders", """SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS position
FROM orders""")
def sorted_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = views.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return prepare.with_positions(prepare.sorted_ranges(orders, "o_totalprice", "o_orderkey"))


def _draw_sql(key: str, block: str, place: str) -> str:
    digits = f"md5('37:' || {key} || ':' || CAST({block} AS VARCHAR))"
    return f"((CAST('0x' || substr({digits}, CAST(8 * ({place}) + 1 AS INTEGER), 8) AS BIGINT) + 0.5) / 4294967296.0)"


_SEEDS_SQL = ", ".join(
    f"CAST('0x' || substr(md5('37:' || CAST(id AS VARCHAR) || ':0'), {8 * k + 1}, 8) AS BIGINT) % {LEHMER_MODULUS} AS s{k}"
    for k in range(3))
_JUMPS_SQL = ", ".join(
    f"[{', '.join(str(pow(m, place + 1, LEHMER_MODULUS)) for place in range(50))}] AS jumps{k}"
    for k, m in enumerate(LEHMER_MULTIPLIERS))
_STREAM_SQL = "((" + " + ".join(f"s{k} * jumps{k}[{{at}}] % {LEHMER_MODULUS}" for k in range(3)) + \
    f") % {LEHMER_MODULUS} + 0.5) / {LEHMER_MODULUS}.0"


def _noise_sql(ids: str) -> str:
    even, odd = (_STREAM_SQL.format(at=f"2 * (i // 2) + {place}") for place in (1, 2))
    return f"""seeds AS (
  SELECT id, {_SEEDS_SQL} FROM ({ids}) t),
noise AS (
  SELECT id, i, sqrt(-2 * ln(CAST({even} AS DOUBLE)))
         * CASE WHEN i % 2 = 0 THEN cos(2 * pi() * CAST({odd} AS DOUBLE)) ELSE sin(2 * pi() * CAST({odd} AS DOUBLE)) END AS g
  FROM seeds CROSS JOIN (SELECT unnest(range(50)) AS i) d CROSS JOIN (SELECT {_JUMPS_SQL}) j)"""


_LINE_IDS_SQL = "SELECT l_orderkey * 10 + l_linenumber AS id FROM lineitem"
_NOISE_SQL = _noise_sql(_LINE_IDS_SQL)
_MOMENTS_SQL = "count(*) AS n, round(avg(v), 6) AS mean, round(var_samp(v), 5) AS variance"


def _moments(data: DataFrame, group: str) -> DataFrame:
    """Count, mean and variance per group and dimension."""
    summary = Summarizer.metrics("mean", "variance", "count").summary(F.col("features"))
    one = data.groupBy(group).agg(summary.alias("s"))
    cells = one.select(group, F.col("s.count").alias("n"), F.posexplode(
        F.arrays_zip(vector_to_array("s.mean").alias("mean"), vector_to_array("s.variance").alias("variance"))))
    return cells.select(group, F.col("pos").cast("bigint").alias("i"), "n", F.round("col.mean", 6).alias("mean"),
                        F.round("col.variance", 5).alias("variance"))


@query("generated_regression", f"""WITH {_noise_sql(_LINE_IDS_SQL.replace('SELECT', 'SELECT DISTINCT'))}
SELECT id, round(sum(CASE WHEN i < 4 THEN 100 * {_draw_sql("'coefficient'", '0', 'i % 4')} * g ELSE 0 END), 5) AS label,
       round(sum(g), 6) AS total
FROM noise GROUP BY id HAVING count(*) = 50""")
def generated_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = synthetic.regression(line_ids(spark, sf_dir).distinct())
    total = F.aggregate(vector_to_array("features"), F.lit(0.0), lambda s, v: s + v)
    return data.select("id", F.round("label", 5).alias("label"), F.round(total, 6).alias("total"))


_LABEL_KEY = "'label:' || CAST(id AS VARCHAR)"


@query("generated_classes", f"""WITH {_NOISE_SQL}, labelled AS (
  SELECT CASE WHEN {_draw_sql(_LABEL_KEY, '0', '0')} < 0.01
              THEN CASE WHEN {_draw_sql(_LABEL_KEY, '0', '1')} < 0.5 THEN 0 ELSE 1 END
              WHEN id % 4 IN (0, 3) THEN 0 ELSE 1 END AS label, i,
         g + CASE i WHEN 0 THEN CASE WHEN id % 4 < 2 THEN -1 ELSE 1 END
                    WHEN 1 THEN CASE WHEN id % 2 = 0 THEN -1 ELSE 1 END ELSE 0 END AS v
  FROM noise)
SELECT CAST(label AS DOUBLE) AS label, i, {_MOMENTS_SQL} FROM labelled GROUP BY label, i""")
def generated_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moments(synthetic.classification(line_ids(spark, sf_dir)), "label")


_CENTER_KEY = "'center ' || CAST(id % 4 AS VARCHAR)"


@query("generated_blobs", f"""WITH {_NOISE_SQL}, placed AS (
  SELECT id % 4 AS label, i, g + 10 * (2 * {_draw_sql(_CENTER_KEY, 'i // 4', 'i % 4')} - 1) AS v FROM noise)
SELECT CAST(label AS DOUBLE) AS label, i, {_MOMENTS_SQL} FROM placed GROUP BY label, i""")
def generated_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moments(synthetic.blobs(line_ids(spark, sf_dir)), "label")
