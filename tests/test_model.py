import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runcast.functions import solvers
from runcast.operators import choice, stats, timemodel
from runcast.plans import views

SF_DIR = "/root/testdata/sf0.001"
KEYS = ["workload"]


def test_planted_model_is_found(spark):
    model = timemodel.fit_time_models(views.runs(spark, SF_DIR), KEYS, select_features=False).where(
        "workload = 'A'").first()
    assert np.allclose(model["coef"], [5.05, 40, 0, 0.3, 2, 0], atol=0.1)


def test_same_under_any_partitioning(spark):
    runs = views.runs(spark, SF_DIR)
    one = {r["workload"]: r for r in timemodel.fit_time_models(runs.coalesce(1), KEYS).collect()}
    many = {r["workload"]: r for r in timemodel.fit_time_models(runs.repartition(13), KEYS).collect()}
    for workload, model in one.items():
        assert model["mask"] == many[workload]["mask"]
        assert np.allclose(model["coef"], many[workload]["coef"], rtol=1e-6, atol=1e-8)


def test_hot_group_is_pre_aggregated(spark):
    runs = views.runs(spark, SF_DIR)
    plan = timemodel.gram_sums(timemodel.model_features(runs, KEYS), KEYS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2 and plan.count("Exchange") == 1
    assert "l_extendedprice" not in plan  # only the needed columns are read


def test_time_zero_counts_in_no_ratio(spark):
    rows = [("w", 2 * m, m, f, float(t)) for (m, f), t in zip(itertools.product([1, 2, 4, 8], [0.25, 0.5, 1.0]), range(12))]
    runs = spark.createDataFrame(rows, "workload string, cores int, machine int, fraction double, time double")
    models = timemodel.fit_time_models(runs, KEYS)
    assert np.isfinite(models.first()["error_pct"])
    scored = timemodel.score_runs(timemodel.model_features(runs, KEYS), models, KEYS)
    direct = scored.where("time > 0").agg((F.avg(F.col("predicted") / F.col("time")) - 1) * 100).first()[0]
    assert abs(direct - models.first()["error_pct"]) < 1e-9
    assert np.isfinite(choice.prediction_accuracy(scored, KEYS).first()["relative_error"])


def test_single_machine_group(spark):
    rows = [("w", 2, 1, f, 3 + 10 * f) for f in (0.1, 0.2, 0.5, 1.0)]
    runs = spark.createDataFrame(rows, "workload string, cores int, machine int, fraction double, time double")
    model = timemodel.fit_time_models(runs, KEYS).first()
    assert abs(model["error_pct"]) < 1e-6
    predicted = timemodel.predict_grid(timemodel.fit_time_models(runs, KEYS), KEYS, machines=1).first()["time"]
    assert abs(predicted - 13) < 1e-6


def test_hot_key_join_beyond_the_broadcast_bound(spark):
    from runcast.operators.keyed import attach
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40).alias("k"), "id")
    table = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    small, large = (attach(rows, table, ["k"], broadcast_bytes=bound) for bound in (1_000_000, 1))
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in large._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))


def _random_system(seed, rows, size):
    rng = np.random.default_rng(seed)
    x = np.concatenate([np.ones((rows, 1)), rng.random((rows, size - 1)) * 10 ** rng.uniform(-2, 2, size - 1)], axis=1)
    return x, x @ rng.normal(size=size) + rng.normal(size=rows)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10 ** 6), st.integers(8, 60))
def test_non_negative_fit_is_optimal(seed, rows):
    x, y = _random_system(seed, rows, 6)
    gram, moment = x.T @ x, x.T @ y
    b = solvers.nonnegative_least_squares(gram[None], moment[None], np.ones((1, 6), dtype=bool))[0]
    slope = (gram @ b - moment) / np.sqrt(np.diag(gram)) / np.linalg.norm(y)
    assert (b >= 0).all()
    assert (slope > -1e-7).all()
    assert np.abs(slope[b > 0]).max(initial=0) < 1e-7


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10 ** 6))
def test_more_features_never_fit_worse(seed):
    x, y = _random_system(seed, 30, 6)
    gram, moment = x.T @ x, x.T @ y
    last = np.inf
    for kept in range(1, 7):
        allowed = np.arange(6)[None] < kept
        b = solvers.nonnegative_least_squares(gram[None], moment[None], allowed)[0]
        assert (b[kept:] == 0).all()
        error = np.sum((y - x @ b) ** 2)
        assert error <= last * (1 + 1e-9)
        last = error


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10 ** 6))
def test_ordinary_fit(seed):
    x, y = _random_system(seed, 40, 6)
    found = solvers.ordinary_least_squares((x.T @ x)[None], (x.T @ y)[None])[0]
    assert np.allclose(x @ found, x @ np.linalg.lstsq(x, y, rcond=None)[0], atol=1e-5)


def test_mask_keeps_a_tenth_of_the_mean(spark):
    slopes = spark.sql("SELECT array(0D, 10D, -1D, 0.5D, -4D, 0.29D) AS ols")  # mean of the five sizes is 3.158
    row = timemodel.with_mask(slopes).first()
    assert row["mask"] == [True, True, True, True, True, False]


def test_variance_mask(spark):
    rows = spark.createDataFrame([("g", 0.0, 0.0), ("g", 1.0, 0.5)], "g string, a double, b double")
    row = stats.variance_mask(rows, ["g"], ["a", "b"]).first()
    assert (row["a"], row["b"]) == (True, False)


def test_ties_in_a_choice(spark):
    rows = [("w", 4, 10.0, 1.0), ("w", 2, 10.0, 1.0), ("w", 1, 30.0, 0.5)]
    options = spark.createDataFrame(rows, "workload string, machine int, time double, cost double")
    assert choice.cheapest_within_deadline(options, KEYS, 20.0).first()["machine"] == 2
    assert choice.fastest_within_budget(options, KEYS, 0.7).first()["machine"] == 1


@pytest.mark.parametrize("kind", ["model", "design"])
def test_feature_maps(spark, kind):
    runs = spark.createDataFrame([("w", 8, 4, 0.25, 1.0)],
                                 "workload string, cores int, machine int, fraction double, time double")
    row = timemodel.model_features(runs, KEYS, kind).first()
    third = 1 / 8 if kind == "model" else 0.5 / 8
    assert np.allclose(row[2:], [1, 0.25 / 8, third, 4, np.log(4), 16])
