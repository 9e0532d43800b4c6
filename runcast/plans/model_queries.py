"""Queries on time models: features, moment sums, mask, fit, errors, predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runcast.functions.features import MODEL_TERMS
from runcast.operators import timemodel
from runcast.plans import sqltext, views
from runcast.plans.registry import query

KEYS = ["workload", "instance_type"]
_GROUPS = "workload, instance_type"
_TERMS = range(6)

_GRAMS = f"""WITH {sqltext.RUNS}, {sqltext.FEATURES}, grams AS (
  SELECT {_GROUPS}, count(*) AS n, {sqltext.moment_sums()}, sum(time * time) AS yy
  FROM features GROUP BY {_GROUPS})"""

_OLS = f"""{_GRAMS}, full_grams AS (SELECT {_GROUPS}, {sqltext.full_matrix()} FROM grams),
{sqltext.elimination('full_grams', ['workload', 'instance_type'], name='ols')}"""

_MASK = f"""{_OLS}, masks AS (
  SELECT {_GROUPS}, TRUE AS k_0, {', '.join(f'abs(c_{i}) >= 0.1 * mean_size AS k_{i}' for i in range(1, 6))}
  FROM (SELECT *, ({' + '.join(f'abs(c_{i})' for i in range(1, 6))}) / 5 AS mean_size FROM ols) t)"""


def _nnls_sql(masks: str) -> str:
    """Best feasible subset of the kept terms, all 64 subsets tried."""
    subset = ", ".join(f"(s // {2 ** i}) % 2 = 1 AS u_{i}" for i in _TERMS)
    within = " AND ".join(f"(k_{i} OR NOT u_{i})" for i in _TERMS)
    unit = ", ".join(
        f"CASE WHEN u_{i} AND u_{j} THEN g_{min(i, j)}_{max(i, j)} / sqrt(g_{i}_{i} * g_{j}_{j}) "
        f"ELSE {1 if i == j else 0} END AS a_{i}_{j}" for i in _TERMS for j in _TERMS)
    right = ", ".join(f"CASE WHEN u_{i} THEN b_{i} / sqrt(g_{i}_{i}) ELSE 0 END AS b_{i}" for i in _TERMS)
    scales = ", ".join(f"1 / sqrt(g_{i}_{i}) AS d_{i}" for i in _TERMS)
    rights = ", ".join(f"CASE WHEN u_{i} THEN b_{i} / sqrt(g_{i}_{i}) ELSE 0 END AS h_{i}" for i in _TERMS)
    keep = ["workload", "instance_type", *[f"d_{i}" for i in _TERMS], *[f"h_{i}" for i in _TERMS]]
    feasible = " AND ".join([f"c_{i} >= 0" for i in _TERMS] + [f"p_{i} > 1e-11" for i in _TERMS])
    gain = " + ".join(f"h_{i} * c_{i}" for i in _TERMS)
    coef = ", ".join(f"c_{i} * d_{i} AS coef_{i}" for i in _TERMS)
    return f"""{masks}, subsets AS (
  SELECT s, {subset} FROM (SELECT unnest(range(64)) AS s) t),
systems AS (
  SELECT {_GROUPS}, {unit}, {right}, {scales}, {rights}
  FROM grams JOIN masks USING ({_GROUPS}) CROSS JOIN subsets WHERE {within}),
{sqltext.elimination('systems', keep, name='nnls')},
models AS (
  SELECT {_GROUPS}, {coef}
  FROM (SELECT *, row_number() OVER (PARTITION BY {_GROUPS} ORDER BY {gain} DESC) AS place
        FROM nnls WHERE {feasible}) t
  WHERE place = 1)"""


MASKED = _MASK
_MODELS = _nnls_sql(_MASK)
ALL_KEPT = _nnls_sql(f"{_GRAMS}, masks AS (SELECT {_GROUPS}, {', '.join(f'TRUE AS k_{i}' for i in _TERMS)} FROM grams)")
_PREDICTED = " + ".join(f"coef_{i} * z{i}" for i in _TERMS)


def _coef_columns(digits: int = 4) -> list:
    return [F.round(F.get("coef", i), digits).alias(f"coef_{i}") for i in _TERMS]


_ROUNDED_COEF = ", ".join(f"round(coef_{i}, 4) AS coef_{i}" for i in _TERMS)


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timemodel.model_features(views.runs(spark, sf_dir), KEYS)


def _models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timemodel.fit_time_models(views.runs(spark, sf_dir), KEYS)


@query("features_model", f"""WITH {sqltext.RUNS}, {sqltext.FEATURES}
SELECT l_orderkey, l_linenumber, workload, round(time, 6) AS time,
       {', '.join(f'round(z{i}, 12) AS z{i}' for i in _TERMS)}
FROM features""")
def features_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = timemodel.model_features(views.runs(spark, sf_dir), ["l_orderkey", "l_linenumber", "workload"])
    return features.select("l_orderkey", "l_linenumber", "workload", F.round("time", 6).alias("time"),
                           *[F.round(z, 12).alias(z) for z in MODEL_TERMS])


_MEAN_MOMENTS = [f"g_{i}_{j}" for i, j in sqltext.pairs(6)] + [f"b_{i}" for i in _TERMS] + ["yy"]


@query("gram_by_group", f"""{_GRAMS}
SELECT {_GROUPS}, n, {', '.join(f'round({c} / n, 5) AS {c}' for c in _MEAN_MOMENTS)} FROM grams""")
def gram_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    grams = timemodel.gram_sums(_features(spark, sf_dir), KEYS)
    return grams.select(*KEYS, "n", *[F.round(F.col(c) / F.col("n"), 5).alias(c) for c in _MEAN_MOMENTS])


@query("ols_by_group", f"{_OLS} SELECT {_GROUPS}, {', '.join(f'round(c_{i}, 4) AS ols_{i}' for i in _TERMS)} FROM ols")
def ols_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    solved = timemodel.with_ols(timemodel.gram_sums(_features(spark, sf_dir), KEYS))
    return solved.select(*KEYS, *[F.round(F.get("ols", i), 4).alias(f"ols_{i}") for i in _TERMS])


@query("ols_mask", f"{_MASK} SELECT {_GROUPS}, {', '.join(f'k_{i}' for i in _TERMS)} FROM masks")
def ols_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = timemodel.with_mask(timemodel.with_ols(timemodel.gram_sums(_features(spark, sf_dir), KEYS)))
    return masked.select(*KEYS, *[F.get("mask", i).alias(f"k_{i}") for i in _TERMS])


@query("selected_feature_means", f"""{_MASK}
SELECT {_GROUPS}, count(*) AS n,
       {', '.join(f'round(avg(CASE WHEN k_{i} THEN z{i} ELSE 0 END), 6) AS z{i}' for i in _TERMS)}
FROM features JOIN masks USING ({_GROUPS}) GROUP BY {_GROUPS}""")
def selected_feature_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = _features(spark, sf_dir)
    masks = timemodel.with_mask(timemodel.with_ols(timemodel.gram_sums(features, KEYS)))
    selected = timemodel.selected_features(features, masks, KEYS)
    return selected.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"),
                                       *[F.round(F.avg(z), 6).alias(z) for z in MODEL_TERMS])


@query("nnls_coef", f"{ALL_KEPT} SELECT {_GROUPS}, {_ROUNDED_COEF} FROM models")
def nnls_coef(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = timemodel.fit_time_models(views.runs(spark, sf_dir), KEYS, select_features=False)
    return fitted.select(*KEYS, *_coef_columns())


@query("selected_nnls_coef", f"{_MODELS} SELECT {_GROUPS}, {_ROUNDED_COEF} FROM models")
def selected_nnls_coef(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _models(spark, sf_dir).select(*KEYS, *_coef_columns())


@query("training_error", f"""{_MODELS}
SELECT {_GROUPS}, round((avg(({_PREDICTED}) / nullif(time, 0)) - 1) * 100, 5) AS error_pct
FROM features JOIN models USING ({_GROUPS}) GROUP BY {_GROUPS}""")
def training_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _models(spark, sf_dir).select(*KEYS, F.round("error_pct", 5).alias("error_pct"))


@query("null_workload_scores", f"""WITH {sqltext.RUNS}
SELECT nullif(workload, 'N') AS workload, instance_type, count(*) AS n, round(avg(time), 5) AS predicted
FROM runs GROUP BY ALL""")
def null_workload_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of an unnamed workload are fitted and scored like any other; with an intercept the mean prediction is the mean."""
    runs = views.runs(spark, sf_dir).withColumn("workload", F.nullif("workload", F.lit("N")))
    features = timemodel.model_features(runs, KEYS)
    models = timemodel.fit_time_models(runs, KEYS, select_features=False)
    return timemodel.score_runs(features, models, KEYS).groupBy(*KEYS).agg(
        F.count("predicted").alias("n"), F.round(F.avg("predicted"), 5).alias("predicted"))


@query("residual_norm", f"""{_MODELS}
SELECT {_GROUPS}, round(sqrt(sum((time - ({_PREDICTED})) * (time - ({_PREDICTED})))), 5) AS rnorm
FROM features JOIN models USING ({_GROUPS}) GROUP BY {_GROUPS}""")
def residual_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    norms = timemodel.residual_norms(_features(spark, sf_dir), _models(spark, sf_dir), KEYS)
    return norms.select(*KEYS, F.round("rnorm", 5).alias("rnorm"))


@query("scored_runs", f"""{_MODELS}
SELECT l_orderkey, l_linenumber, workload, instance_type, round({_PREDICTED}, 4) AS predicted
FROM features JOIN models USING ({_GROUPS})""")
def scored_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = timemodel.model_features(views.runs(spark, sf_dir), ["l_orderkey", "l_linenumber", *KEYS])
    scored = timemodel.score_runs(features, _models(spark, sf_dir), KEYS)
    return scored.select("l_orderkey", "l_linenumber", *KEYS, F.round("predicted", 4).alias("predicted"))


PREDICTIONS = f"""{_MODELS}, predictions AS (
  SELECT {_GROUPS}, CAST(machine AS INTEGER) AS machine,
         coef_0 + coef_1 / (2 * machine) + coef_2 / (2 * machine) + coef_3 * machine + coef_4 * ln(machine)
           + coef_5 * machine * machine AS time
  FROM models CROSS JOIN (SELECT unnest(range(1, 41)) AS machine) t)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timemodel.predict_grid(_models(spark, sf_dir), KEYS)


@query("predict_grid", f"{PREDICTIONS} SELECT {_GROUPS}, machine, round(time, 4) AS time FROM predictions")
def predict_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).select(*KEYS, "machine", F.round("time", 4).alias("time"))


_DESIGN_MAP_FEATURES = sqltext.FEATURES.replace("1 / cores AS z2", "sqrt(fraction) / cores AS z2")


@query("gram_design_map", f"""WITH {sqltext.RUNS}, {_DESIGN_MAP_FEATURES}, grams AS (
  SELECT workload, count(*) AS n, {sqltext.moment_sums()} FROM features GROUP BY workload)
SELECT workload, n, {', '.join(f'round({c} / n, 5) AS {c}' for c in _MEAN_MOMENTS[:-1])} FROM grams""")
def gram_design_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = timemodel.model_features(views.runs(spark, sf_dir), ["workload"], kind="design")
    grams = timemodel.gram_sums(features, ["workload"])
    return grams.select("workload", "n", *[F.round(F.col(c) / F.col("n"), 5).alias(c) for c in _MEAN_MOMENTS[:-1]])


# every fold refitted from the rows of the other folds
_FOLDS = 5
_FOLDED_MODELS = (
    ALL_KEPT.replace("instance_type, machine, 2 *", f"instance_type, CAST(l_orderkey % {_FOLDS} AS INTEGER) AS own, machine, 2 *")
    .replace("workload, instance_type", "workload, instance_type, fold")
    .replace("workload, instance_type, fold, CAST(l_orderkey", "workload, instance_type, CAST(l_orderkey")
    .replace("FROM features GROUP BY", f"FROM (SELECT *, unnest(range({_FOLDS})) AS fold FROM features) x "
                                       "WHERE own <> fold GROUP BY"))


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = views.runs(spark, sf_dir).withColumn("fold", (F.col("l_orderkey") % _FOLDS).cast("int"))
    return timemodel.model_features(runs, [*KEYS, "fold"])


@query("fold_coef", f"""{_FOLDED_MODELS} SELECT workload, instance_type, CAST(fold AS INTEGER) AS fold, {_ROUNDED_COEF}
FROM models""")
def fold_coef(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timemodel.fold_models(_folded(spark, sf_dir), KEYS).select(*KEYS, "fold", *_coef_columns())


@query("cross_validation", f"""{_FOLDED_MODELS}
SELECT f.workload, f.instance_type, count(DISTINCT own) AS folds, count(*) AS n,
       round(sqrt(avg((time - ({_PREDICTED})) * (time - ({_PREDICTED})))), 5) AS rmse,
       round((avg(({_PREDICTED}) / time) - 1) * 100, 5) AS error_pct
FROM features f JOIN models m ON f.workload = m.workload AND f.instance_type = m.instance_type AND f.own = m.fold
GROUP BY f.workload, f.instance_type""")
def cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = timemodel.cross_validation(_folded(spark, sf_dir), KEYS)
    return errors.withColumns({"rmse": F.round("rmse", 5), "error_pct": F.round("error_pct", 5)})


# sums of every level, shrunk from the top down; left out keys are named here, as nulls do not join
_BORROWED = 40.0
_SUM_NAMES = [f"g_{i}_{j}" for i, j in sqltext.pairs(6)] + [f"b_{i}" for i in _TERMS]


def _borrow(level: str, parent: str, same: str) -> str:
    sums = ", ".join(f"c.{s} + {_BORROWED} * p.{s} / p.weight AS {s}" for s in _SUM_NAMES)
    return (f"SELECT c.workload, c.instance_type, c.level, c.n, c.n + {_BORROWED} AS weight, {sums} "
            f"FROM levels c JOIN {parent} p ON {same} WHERE c.level IN ({level})")


_LEVELS = ALL_KEPT.replace(
    f"""grams AS (
  SELECT {_GROUPS}, count(*) AS n, {sqltext.moment_sums()}, sum(time * time) AS yy
  FROM features GROUP BY {_GROUPS})""", f"""levels AS (
  SELECT coalesce(workload, '*') AS workload, coalesce(instance_type, -1) AS instance_type,
    CAST(grouping_id(workload, instance_type) AS INTEGER) AS level, count(*) AS n, {sqltext.moment_sums()}
  FROM features GROUP BY GROUPING SETS (({_GROUPS}), (workload), (instance_type), ())),
top AS (SELECT workload, instance_type, level, n, n AS weight, {', '.join(_SUM_NAMES)} FROM levels WHERE level = 3),
middle AS ({_borrow('1, 2', 'top', 'TRUE')}),
finest AS ({_borrow('0', 'middle', "p.level = 1 AND p.workload = c.workload")}),
grams AS (SELECT * FROM top UNION ALL BY NAME SELECT * FROM middle UNION ALL BY NAME SELECT * FROM finest)""")


@query("level_models", f"""{_LEVELS}
SELECT nullif(workload, '*') AS workload, nullif(instance_type, -1) AS instance_type, level, n, {_ROUNDED_COEF}
FROM models JOIN grams USING ({_GROUPS})""")
def level_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = timemodel.level_models(_features(spark, sf_dir), KEYS, _BORROWED)
    return models.select(*KEYS, "level", "n", *_coef_columns())
