import numpy as np
from pyspark.sql import functions as F

from runcast.operators import timemodel

KEYS = ["workload", "kind"]


def runs(spark, rows=600):
    machine = (1 + F.col("id") % 8).cast("double")
    return spark.range(rows).select(
        F.when(F.col("id") % 3 > 0, "hot").alias("workload"), (F.floor(F.col("id") / 48) % 2).cast("int").alias("kind"),
        (F.pmod(F.hash("id"), F.lit(4))).alias("fold"), machine.alias("machine"), (2 * machine).alias("cores"),
        ((1 + F.col("id") % 16) / 16).alias("fraction"),
        (4 + 30 * (1 + F.col("id") % 16) / 32 / machine + 0.5 * machine + F.pmod(F.hash("id"), F.lit(97)) / 500).alias("time"))


def plain_fit(part):
    """Least squares without signs; the data's coefficients are all positive."""
    m, x = part["machine"].to_numpy(), part["fraction"].to_numpy() / part["cores"].to_numpy()
    return np.stack([np.ones(len(m)), x, 1 / part["cores"].to_numpy(), m, np.log(m), m * m], axis=1)


def test_held_out_errors_against_refits(spark):
    df = runs(spark)
    features = timemodel.model_features(df, [*KEYS, "fold"])
    got = {(r["workload"], r["kind"]): r for r in timemodel.cross_validation(features, KEYS).collect()}
    assert set(got) == {("hot", 0), ("hot", 1), (None, 0), (None, 1)}
    rows = df.toPandas()
    fitted = {tuple(r)[:3]: np.array(r["coef"]) for r in timemodel.fold_models(features, KEYS).select(*KEYS, "fold", "coef").collect()}
    for (workload, kind), row in got.items():
        own = rows[(rows["workload"].isna() if workload is None else rows["workload"] == workload) & (rows["kind"] == kind)]
        refits = {fold: timemodel.fit_time_models(
            df.where(F.col("workload").eqNullSafe(F.lit(workload)) & (F.col("kind") == kind) & (F.col("fold") != fold)), KEYS,
            select_features=False).first()["coef"] for fold in (0, 3)}
        for fold, coef in refits.items():
            np.testing.assert_allclose(fitted[workload, kind, fold], coef, atol=1e-6)
        gaps = [(plain_fit(part) @ fitted[workload, kind, fold] - part["time"], part["time"]) for fold, part in own.groupby("fold")]
        error, time = np.concatenate([g for g, _ in gaps]), np.concatenate([t for _, t in gaps])
        assert row["folds"] == 4 and row["n"] == len(own)
        assert abs(row["rmse"] - np.sqrt((error ** 2).mean())) < 1e-6
        assert abs(row["error_pct"] - 100 * (error / time).mean()) < 1e-6


def test_a_group_of_one_fold_has_no_errors(spark):
    features = timemodel.model_features(runs(spark, 60).withColumn("fold", F.col("kind")), [*KEYS, "fold"])
    got = timemodel.cross_validation(features, KEYS).collect()
    assert {(r["folds"], r["n"], r["rmse"], r["error_pct"]) for r in got} == {(0, 0, None, None)}


def test_levels_have_the_sums_of_their_rows(spark):
    features = timemodel.model_features(runs(spark), KEYS)
    levels = {(r["level"], r["workload"], r["kind"]): r["coef"] for r in timemodel.level_models(features, KEYS).collect()}
    assert len(levels) == 9  # a null workload is a group of its own beside the level without workloads
    alone = timemodel.fit_time_models(runs(spark).where("workload is null"), ["kind"], select_features=False).collect()
    for row in alone:
        np.testing.assert_allclose(levels[0, None, row["kind"]], row["coef"], rtol=1e-6, atol=1e-8)
    whole = timemodel.fit_time_models(runs(spark).withColumn("all", F.lit(1)), ["all"], select_features=False).first()["coef"]
    np.testing.assert_allclose(levels[3, None, None], whole, rtol=1e-6, atol=1e-8)


def test_small_groups_borrow_from_their_parent(spark):
    small = runs(spark, 3).select(F.lit("hot").alias("workload"), F.lit(9).alias("kind"), "fold", "machine", "cores", "fraction",
                                  (F.col("time") + 5).alias("time"))
    features = timemodel.model_features(runs(spark).union(small), KEYS)
    free = {(r["level"], r["workload"], r["kind"]): r["coef"] for r in timemodel.level_models(features, KEYS).collect()}
    tied = {(r["level"], r["workload"], r["kind"]): r["coef"] for r in timemodel.level_models(features, KEYS, 300.0).collect()}
    assert set(free) == set(tied) and free[3, None, None] == tied[3, None, None]
    at = np.array([1, 0.5 / 8, 1 / 8, 4, np.log(4), 16])
    predicted = lambda coef: float(at @ np.array(coef))
    parent = predicted(tied[1, "hot", None])
    assert abs(predicted(tied[0, "hot", 9]) - parent) < 0.2 < abs(predicted(free[0, "hot", 9]) - parent)
    assert abs(predicted(tied[0, "hot", 1]) - predicted(free[0, "hot", 1])) < 0.1
