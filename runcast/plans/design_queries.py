"""Queries on experiment design; every part is one design problem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runcast.functions.features import DESIGN_TERMS
from runcast.operators import design
from runcast.operators.keyed import attach
from runcast.plans import sqltext, views
from runcast.plans.registry import query
from runcast.session import materialize

KEYS = ["workload"]
_GAP_LIMIT = 1e-3

# the same share of every candidate, as large as the budget allows
_EQUAL = f"""WITH {sqltext.CANDIDATES}, weighted AS (
  SELECT d.*, least(CAST(1 AS DOUBLE), budget / total) AS weight
  FROM design d JOIN (SELECT workload, sum(cost) AS total FROM candidates GROUP BY workload) t USING (workload))"""

_INFORMATION = f"""{_EQUAL}, means AS (
  SELECT workload, {', '.join(f'CASE WHEN avg(x{i}) = 0 THEN 1 ELSE avg(x{i}) END AS mean_{i}' for i in range(6))}
  FROM design GROUP BY workload),
scaled AS (
  SELECT workload, weight, cost, {', '.join(f'x{i} / mean_{i} AS y{i}' for i in range(6))}
  FROM weighted JOIN means USING (workload)),
information AS (
  SELECT workload, count(*) AS n, sum(weight * cost) AS cost,
         {', '.join(f'sum(weight * y{i} * y{j}) AS m_{i}_{j}' for i, j in sqltext.pairs(6))}
  FROM scaled GROUP BY workload)"""

_SYSTEMS = f"""{_INFORMATION}, systems AS (
  SELECT workload, k, {', '.join(f'm_{min(i, j)}_{max(i, j)} AS a_{i}_{j}' for i in range(6) for j in range(6))},
         {', '.join(f'CASE WHEN k = {i} THEN 1 ELSE 0 END AS b_{i}' for i in range(6))}
  FROM information CROSS JOIN (SELECT unnest(range(6)) AS k) t),
{sqltext.elimination('systems', ['workload', 'k'], name='unit')}"""


def _problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.design_problems(spark, sf_dir)


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return design.design_features(design.candidates(_problems(spark, sf_dir)))


def _equal_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _features(spark, sf_dir)
    total = rows.groupBy("workload").agg(F.sum("cost").alias("total"))
    return attach(rows, total, KEYS).withColumn("weight", F.least(F.lit(1.0), F.col("budget") / F.col("total")))


@query("candidate_grid", f"""WITH {sqltext.CANDIDATES}
SELECT workload, machine, count(*) AS n, round(min(fraction), 9) AS least_fraction,
       round(max(fraction), 9) AS most_fraction, round(sum(cost), 6) AS cost
FROM candidates GROUP BY workload, machine""")
def candidate_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return design.candidates(_problems(spark, sf_dir)).groupBy("workload", "machine").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.min("fraction"), 9).alias("least_fraction"),
        F.round(F.max("fraction"), 9).alias("most_fraction"), F.round(F.sum("cost"), 6).alias("cost"))


@query("design_features", f"""WITH {sqltext.CANDIDATES}
SELECT workload, step, machine, {', '.join(f'round({x}, 12) AS {x}' for x in DESIGN_TERMS)} FROM design""")
def design_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir).select("workload", F.col("step").cast("bigint").alias("step"), "machine",
                                           *[F.round(x, 12).alias(x) for x in DESIGN_TERMS])


@query("design_column_means", f"""WITH {sqltext.CANDIDATES}
SELECT workload, {', '.join(f'round(avg({x}), 8) AS mean_{x}' for x in DESIGN_TERMS)} FROM design GROUP BY workload""")
def design_column_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = design.column_means(_features(spark, sf_dir), KEYS)
    return means.select("workload", *[F.round(f"mean_{x}", 8).alias(f"mean_{x}") for x in DESIGN_TERMS])


@query("normalized_products", f"""{_INFORMATION}
SELECT workload, {', '.join(f'round(avg(y{i} * y{j}), 8) AS m_{i}_{j}' for i, j in sqltext.pairs(6))}
FROM scaled GROUP BY workload""")
def normalized_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = design.normalized(_features(spark, sf_dir), KEYS)
    return scaled.groupBy("workload").agg(*[
        F.round(F.avg(F.col(f"x{i}") * F.col(f"x{j}")), 8).alias(f"m_{i}_{j}") for i, j in sqltext.pairs(6)])


@query("information_matrix", f"""{_INFORMATION}
SELECT workload, n, round(cost, 7) AS cost, {', '.join(f'round({m}, 7) AS {m}' for m in design.INFORMATION)}
FROM information""")
def information_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = design.information(_equal_weights(spark, sf_dir), KEYS, "weight")
    return found.select("workload", "n", F.round("cost", 7).alias("cost"),
                        *[F.round(m, 7).alias(m) for m in design.INFORMATION])


@query("design_objectives", f"""{_SYSTEMS}
SELECT workload, round(any_value({' + '.join(f'ln(p_{i})' for i in range(6))}), 5) AS log_det,
       round(sum(CASE k {' '.join(f'WHEN {i} THEN c_{i}' for i in range(6))} END), 2) AS inverse_trace
FROM unit GROUP BY workload""")
def design_objectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = design.objectives(design.information(_equal_weights(spark, sf_dir), KEYS, "weight"))
    return found.select("workload", F.round("log_det", 5).alias("log_det"),
                        F.round("inverse_trace", 2).alias("inverse_trace"))


@query("design_cost", f"""{_EQUAL}
SELECT workload, round(sum(weight * cost), 6) AS cost FROM weighted GROUP BY workload""")
def design_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return design.run_cost(_equal_weights(spark, sf_dir), KEYS).select("workload", F.round("cost", 6).alias("cost"))


@query("design_report", f"""{_EQUAL}
SELECT workload, CAST(ceil(fraction * total_parts) AS INTEGER) AS parts,
       printf('%d, %f, %f', machine, fraction + 1e-12, weight + 1e-12) AS line
FROM weighted WHERE weight > 0.1""")
def design_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = design.chosen_runs(_equal_weights(spark, sf_dir), KEYS)
    return design.design_report(chosen).select("workload", "parts", "line")


@query("design_weights", f"""WITH {sqltext.CANDIDATES}
SELECT workload, CASE WHEN sum(cost) <= any_value(budget) THEN 'all' ELSE 'done' END AS status, TRUE AS from_candidates,
       TRUE AS within_budget, TRUE AS in_order, CASE WHEN sum(cost) <= any_value(budget) THEN count(*) ELSE 0 END AS runs_of_all
FROM candidates GROUP BY workload""")
def design_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every design's runs are candidates, keep the budget, and stand in order of their weights."""
    problems = _problems(spark, sf_dir)
    chosen = materialize(design.design_runs(problems, KEYS), "chosen")
    # Spark takes the candidates for as small as the problems they fan out from: unhinted, it broadcasts them all
    grid = design.candidates(problems).select("workload", "machine", F.round("fraction", 9).alias("f"), "cost", "budget")
    placed = chosen.withColumn("f", F.round("fraction", 9)).join(grid.hint("merge"), ["workload", "machine", "f"], "left")
    before = F.lag("weight").over(Window.partitionBy("workload").orderBy("position"))
    placed = placed.withColumn("falls", F.coalesce(before >= F.col("weight"), F.lit(True)))
    return placed.groupBy("workload").agg(
        F.first("status").alias("status"), F.bool_and(F.col("cost").isNotNull()).alias("from_candidates"),
        (F.sum(F.col("weight") * F.col("cost")) <= F.first("budget") + 1e-9).alias("within_budget"),
        F.bool_and("falls").alias("in_order"),
        F.when(F.first("status") == "all", F.count(F.lit(1))).otherwise(F.lit(0)).alias("runs_of_all"))


@query("design_defaults", """SELECT p_size AS workload, 1 AS min_machines, 16 AS max_machines, 2 AS cores_per_machine,
  CAST(10 AS DOUBLE) AS budget, 16 AS steps, CAST(count(*) AS BIGINT) AS problems FROM part GROUP BY p_size""")
def design_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems that only state their partitions get the fixed defaults."""
    parts = views.table(spark, sf_dir, "part").select(
        F.col("p_size").alias("workload"), F.lit(3).alias("min_parts"), F.lit(20).alias("max_parts"),
        F.lit(256).alias("total_parts"))
    return design.with_defaults(parts).groupBy(
        "workload", "min_machines", "max_machines", "cores_per_machine", "budget", "steps").agg(
        F.count(F.lit(1)).alias("problems"))


_LARGE = {"min_parts": "256", "max_parts": "2048", "total_parts": "4096", "min_machines": "1",
          "max_machines": "110 + p_size % 2 * 10", "cores_per_machine": "2", "budget": "CAST(40 AS DOUBLE)", "steps": "120"}
_LARGE_CANDIDATES = "WITH " + sqltext.CANDIDATES.replace(sqltext.PROBLEMS, f"""problems AS (
  SELECT DISTINCT p_size % 2 AS workload, {', '.join(f'{text} AS {name}' for name, text in _LARGE.items())} FROM part)""")


@query("large_design_certificate", f"""{_LARGE_CANDIDATES}
SELECT CAST(workload AS INTEGER) AS workload, count(*) AS n, TRUE AS within_bounds, TRUE AS within_budget,
  TRUE AS proven_optimal, TRUE AS same_as_whole
FROM candidates GROUP BY workload""")
def large_design_certificate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Designs of over 10,000 candidates in several tiles, solved in rounds of sums: proven, and equal to the whole solution."""
    shapes = views.table(spark, sf_dir, "part").select(
        (F.col("p_size") % 2).alias("workload"), *[F.expr(text).alias(name) for name, text in _LARGE.items()]).distinct()
    shapes = materialize(shapes, "large-problems")
    rounds = design.optimal_weights(shapes)
    whole = design.optimal_weights(shapes, local_candidates=1 << 20)
    keys = [*design.PROBLEM, "step", "machine"]
    both = rounds.join(whole.select(*keys, F.col("weight").alias("other")), keys, "full")
    same = both.groupBy(*design.PROBLEM).agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_and(F.coalesce(F.abs(F.col("weight") - F.col("other")) <= 1e-4, F.lit(False))).alias("same_as_whole"))
    checked = (same.join(design.constraint_check(rounds, design.PROBLEM), design.PROBLEM)
               .join(design.optimality_gap(rounds, design.PROBLEM, "D"), design.PROBLEM))
    return shapes.join(checked, design.PROBLEM).select(
        "workload", "n", (F.col("bound_violation") <= 1e-9).alias("within_bounds"),
        (F.col("budget_violation") <= 1e-9).alias("within_budget"),
        (F.col("gap") <= _GAP_LIMIT).alias("proven_optimal"), "same_as_whole")


_CERTIFICATE_SQL = f"""WITH {sqltext.CANDIDATES}
SELECT workload, count(*) AS n, TRUE AS within_bounds, TRUE AS within_budget, TRUE AS proven_optimal,
       sum(cost) <= any_value(budget) AS takes_all
FROM candidates GROUP BY workload"""


def _certificate(spark: SparkSession, sf_dir: str, criterion: str) -> DataFrame:
    """The optimal weights are feasible and proven within ``_GAP_LIMIT`` of the best objective.

    The limit is absolute for the logarithm of "D" and relative for "A".
    """
    problems = _problems(spark, sf_dir)
    shapes = design.optimal_weights(problems, criterion=criterion)
    counts = shapes.groupBy(*design.PROBLEM).agg(F.count(F.lit(1)).alias("n"),
                                                 F.max(F.col("status") == "all").alias("takes_all"))
    checked = (counts.join(design.constraint_check(shapes, design.PROBLEM), design.PROBLEM)
               .join(design.optimality_gap(shapes, design.PROBLEM, criterion), design.PROBLEM))
    limit = F.lit(_GAP_LIMIT) if criterion == "D" else _GAP_LIMIT * F.col("objective")
    return problems.join(checked, design.PROBLEM).select(
        "workload", "n", (F.col("bound_violation") <= 1e-9).alias("within_bounds"),
        (F.col("budget_violation") <= 1e-9).alias("within_budget"),
        (F.col("gap") <= limit).alias("proven_optimal"), "takes_all")


@query("design_certificate", _CERTIFICATE_SQL)
def design_certificate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _certificate(spark, sf_dir, "D")


@query("trace_design_certificate", _CERTIFICATE_SQL)
def trace_design_certificate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _certificate(spark, sf_dir, "A")
