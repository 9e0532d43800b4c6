"""Queries from predictions to a choice of cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runcast.functions import sqlfunctions
from runcast.operators import choice, timemodel
from runcast.operators.keyed import attach
from runcast.operators.ordered import as_of_join
from runcast.plans import model_queries, sqltext, views
from runcast.plans.model_queries import KEYS, PREDICTIONS, predictions
from runcast.plans.registry import query
from runcast.session import materialize

_DEADLINE = 20.0
_SPENDING = 0.02

# hourly price per instance type: mean supplier balance of three classes, in cents; type 2 has no price
_PRICES = """prices AS (
  SELECT CAST(s_suppkey % 3 AS INTEGER) AS instance_type, avg(abs(s_acctbal)) / 100000 AS hourly_price
  FROM supplier WHERE s_suppkey % 3 <> 2 GROUP BY ALL)"""
_OPTIONS = f"""{PREDICTIONS}, {_PRICES}, options AS (
  SELECT workload, instance_type, machine, time, time / 3600 * machine * hourly_price AS cost
  FROM predictions LEFT JOIN prices USING (instance_type))"""


def _prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "supplier").where("s_suppkey % 3 <> 2").groupBy(
        (F.col("s_suppkey") % 3).cast("int").alias("instance_type")).agg(
        (F.avg(F.abs("s_acctbal")) / 100000).alias("hourly_price"))


def _options(spark: SparkSession, sf_dir: str) -> DataFrame:
    priced = choice.priced(predictions(spark, sf_dir), _prices(spark, sf_dir))
    return priced.select("workload", "instance_type", "machine", "time", "cost")


@query("estimated_cost", f"""{_OPTIONS}
SELECT workload, instance_type, machine, round(time, 4) AS time, round(cost, 7) AS cost FROM options""")
def estimated_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _options(spark, sf_dir).withColumns({"time": F.round("time", 4), "cost": F.round("cost", 7)})


def _pick_sql(condition: str, order: str) -> str:
    return f"""{_OPTIONS}
SELECT workload, instance_type, machine, round(time, 4) AS time, round(cost, 7) AS cost
FROM (SELECT *, row_number() OVER (PARTITION BY workload ORDER BY {order}) AS place FROM options WHERE {condition}) t
WHERE place = 1"""


def _picked(found: DataFrame) -> DataFrame:
    return found.select("workload", "instance_type", "machine", F.round("time", 4).alias("time"),
                        F.round("cost", 7).alias("cost"))


@query("cheapest_config", _pick_sql(f"time <= {_DEADLINE} AND cost IS NOT NULL", "cost, time, machine"))
def cheapest_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _picked(choice.cheapest_within_deadline(_options(spark, sf_dir), ["workload"], _DEADLINE))


@query("fastest_config", _pick_sql(f"cost <= {_SPENDING}", "time, cost, machine"))
def fastest_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _picked(choice.fastest_within_budget(_options(spark, sf_dir), ["workload"], _SPENDING))


# every measured run is an option here: hundreds of thousands a workload, of which a few are not beaten
_MEASURED = f"""WITH {sqltext.RUNS}, {_PRICES}, measured AS (
  SELECT workload, instance_type, CAST(machine AS INTEGER) AS machine, fraction, round(time, 6) AS time,
         round(time, 6) / 3600 * CAST(machine AS INTEGER) * hourly_price AS cost
  FROM runs JOIN prices USING (instance_type)),
ranked AS (
  SELECT *, min(cost) OVER (PARTITION BY workload ORDER BY time, cost, instance_type, machine, fraction
                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below
  FROM measured),
frontier AS (SELECT * EXCLUDE (below) FROM ranked WHERE below IS NULL OR cost < below)"""
_CONFIG = ["instance_type", "machine", "fraction", "time", "cost"]


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = views.runs(spark, sf_dir).select("workload", "instance_type", F.col("machine").cast("int").alias("machine"),
                                            "fraction", F.round("time", 6).alias("time"))
    return choice.priced(runs, _prices(spark, sf_dir)).where("cost is not null").select("workload", *_CONFIG)


@query("pareto_configs", f"""{_MEASURED}
SELECT workload, instance_type, machine, fraction, time, round(cost, 9) AS cost FROM frontier""")
def pareto_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return choice.pareto_configs(_measured(spark, sf_dir), ["workload"]).withColumn("cost", F.round("cost", 9))


# a deadline and a budget for every order, most of them for one workload
_LIMITS = """limits AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 0 THEN 'A' WHEN o_orderkey % 8 = 1 THEN 'R' ELSE 'N' END AS workload,
         5 + o_totalprice / 40000 AS deadline, o_totalprice / 10000000 AS budget
  FROM orders)"""


def _limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    workload = F.when(key % 8 == 0, "A").when(key % 8 == 1, "R").otherwise("N").alias("workload")
    return views.table(spark, sf_dir, "orders").select(
        "o_orderkey", workload, (5 + price / 40000).alias("deadline"), (price / 10000000).alias("budget"))


def _chosen(found: DataFrame, limit: str) -> DataFrame:
    return found.select("o_orderkey", "workload", limit, "instance_type", "machine", "fraction", "time",
                        F.round("cost", 9).alias("cost"))


@query("choice_by_deadline", f"""{_MEASURED}, {_LIMITS}
SELECT o_orderkey, l.workload, deadline, instance_type, machine, fraction, time, round(cost, 9) AS cost
FROM limits l ASOF LEFT JOIN frontier f ON l.workload = f.workload AND l.deadline >= f.time""")
def choice_by_deadline(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = choice.cheapest_for_deadlines(_measured(spark, sf_dir), _limits(spark, sf_dir).drop("budget"), ["workload"], "deadline")
    return _chosen(found, "deadline")


@query("choice_by_budget", f"""{_MEASURED}, {_LIMITS}
SELECT o_orderkey, l.workload, budget, instance_type, machine, fraction, time, round(cost, 9) AS cost
FROM limits l ASOF LEFT JOIN frontier f ON l.workload = f.workload AND l.budget >= f.cost""")
def choice_by_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = choice.fastest_for_budgets(_measured(spark, sf_dir), _limits(spark, sf_dir).drop("deadline"), ["workload"], "budget")
    return _chosen(found, "budget")


# base model per workload: fitted on instance type 0 alone
_BASE = model_queries.ALL_KEPT.replace("FROM lineitem) t)", "FROM lineitem) t WHERE instance_type = 0)")
_SCORED = f"""{_BASE}, every_run AS ({sqltext.RUNS.split('AS (', 1)[1][:-1]}),
based AS (
  SELECT r.*, coef_0 + coef_1 * fraction / cores + coef_2 / cores + coef_3 * machine + coef_4 * ln(machine)
           + coef_5 * machine * machine AS base
  FROM every_run r JOIN (SELECT * EXCLUDE (instance_type) FROM models) m USING (workload)),
factors AS (
  SELECT workload, instance_type, sum(time * base) / sum(base * base) AS factor FROM based
  GROUP BY workload, instance_type)"""


def _base(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Base models, fitted once and written, and all runs with the base prediction."""
    runs = views.runs(spark, sf_dir)
    models = materialize(timemodel.fit_time_models(runs.where("instance_type = 0"), ["workload"], select_features=False),
                         "base-models")
    features = timemodel.model_features(runs, [*KEYS, "fraction"])
    scored = timemodel.score_runs(features, models, ["workload"], stored=True)
    return models, scored.withColumnRenamed("predicted", "base")


@query("transfer_factor", f"{_SCORED} SELECT workload, instance_type, round(factor, 7) AS factor FROM factors")
def transfer_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    factors = choice.transfer_factors(_base(spark, sf_dir)[1], "base", KEYS)
    return factors.withColumn("factor", F.round("factor", 7))


@query("transferred_predictions", f"""{_SCORED}
SELECT workload, f.instance_type, CAST(machine AS INTEGER) AS machine,
       round(factor * (coef_0 + coef_1 / (2 * machine) + coef_2 / (2 * machine) + coef_3 * machine
                       + coef_4 * ln(machine) + coef_5 * machine * machine), 4) AS time
FROM models m JOIN factors f USING (workload) CROSS JOIN (SELECT unnest(range(1, 41)) AS machine) t""")
def transferred_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    models, based = _base(spark, sf_dir)
    moved = choice.transferred(timemodel.predict_grid(models, ["workload"]),
                               choice.transfer_factors(based, "base", KEYS), ["workload"])
    return moved.select(*KEYS, "machine", F.round("time", 4).alias("time"))


@query("prediction_accuracy", f"""{_SCORED}
SELECT workload, instance_type, count(*) AS n, round(avg(abs(factor * base - time) / time), 8) AS relative_error
FROM based JOIN factors USING (workload, instance_type) WHERE fraction = 1 GROUP BY workload, instance_type""")
def prediction_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transferred predictions against the runs on the whole input: one scan for the factors, one for the errors."""
    based = _base(spark, sf_dir)[1]
    factors = materialize(choice.transfer_factors(based, "base", KEYS), "factors")
    scored = attach(based.where("fraction = 1"), factors, KEYS, stored=True)
    scored = scored.withColumn("predicted", F.col("base") * F.col("factor"))
    return choice.prediction_accuracy(scored, KEYS).withColumn("relative_error", F.round("relative_error", 8))


# a line of time over fraction per core for every month and workload, known from the next month on
_MONTHLY = f"""WITH {sqltext.RUNS.replace('l_discount AS time', 'l_discount AS time, CAST(l_shipdate AS DATE) AS day')},
models AS (
  SELECT workload, CAST(date_trunc('month', day) + INTERVAL 1 MONTH AS DATE) AS fitted,
         regr_slope(time, fraction / cores) AS slope, regr_intercept(time, fraction / cores) AS base, count(*) AS n
  FROM runs GROUP BY ALL)"""


@query("asof_model_scores", f"""{_MONTHLY}
SELECT l_orderkey, l_linenumber, r.workload, CAST(day AS VARCHAR) AS day, CAST(fitted AS VARCHAR) AS fitted, n,
       round(base + slope * (fraction / cores), 5) AS predicted
FROM runs r ASOF LEFT JOIN models m ON r.workload = m.workload AND r.day >= m.fitted""")
def asof_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run scored by the model that was fitted last before its day; the first month has none."""
    ratio = F.col("fraction") / F.col("cores")
    dated = views.dated_runs(spark, sf_dir)
    models = dated.groupBy("workload", F.add_months(F.trunc("day", "month"), 1).alias("fitted")).agg(
        F.regr_slope("time", ratio).alias("slope"), F.regr_intercept("time", ratio).alias("base"),
        F.count(F.lit(1)).alias("n"))
    scored = as_of_join(dated, models, ["workload"], "day", "fitted", ["fitted", "slope", "base", "n"])
    return scored.select("l_orderkey", "l_linenumber", "workload", F.col("day").cast("string").alias("day"),
                         F.col("fitted").cast("string").alias("fitted"), "n",
                         F.round(F.col("base") + F.col("slope") * ratio, 5).alias("predicted"))


# the same plans written in SQL, by the functions of the session

@query("sql_features", f"""WITH {sqltext.RUNS}, {sqltext.FEATURES}
SELECT l_orderkey, l_linenumber, workload, {', '.join(f'round(z{i}, 12) AS z{i}' for i in range(6))} FROM features""")
def sql_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    sqlfunctions.register(spark)
    terms = ", ".join(f"round(terms[{i}], 12) AS z{i}" for i in range(6))
    return spark.sql(f"""SELECT l_orderkey, l_linenumber, workload, {terms}
        FROM (SELECT *, model_terms(cores, machine, fraction) AS terms FROM {{runs}})""", runs=views.runs(spark, sf_dir))


@query("sql_predict_grid", f"{PREDICTIONS} SELECT workload, instance_type, machine, round(time, 4) AS time FROM predictions")
def sql_predict_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    sqlfunctions.register(spark)
    models = timemodel.fit_time_models(views.runs(spark, sf_dir), KEYS)
    return spark.sql("""SELECT workload, instance_type, machine, round(predicted_time(coef, 2 * machine, machine, 1), 4) AS time
        FROM (SELECT *, explode(sequence(1, 40)) AS machine FROM {models})""", models=models)


@query("sql_cost", f"""{_OPTIONS}
SELECT workload, instance_type, machine, round(time, 4) AS time, round(cost, 7) AS cost FROM options""")
def sql_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    sqlfunctions.register(spark)
    models = timemodel.fit_time_models(views.runs(spark, sf_dir), KEYS)
    return spark.sql("""WITH options AS (
          SELECT workload, instance_type, machine, predicted_time(coef, 2 * machine, machine, 1) AS time
          FROM (SELECT *, explode(sequence(1, 40)) AS machine FROM {models}))
        SELECT o.workload, o.instance_type, o.machine, round(time, 4) AS time,
               round(run_price(time, machine, hourly_price), 7) AS cost
        FROM options o LEFT JOIN {prices} p ON o.instance_type = p.instance_type""", models=models, prices=_prices(spark, sf_dir))
