import itertools

import numpy as np
from pyspark.sql import functions as F

from runcast.operators import association, timemodel
from runcast.plans import views


def frame(spark, rows=4000):
    ids = spark.range(rows)
    noise = (F.pmod(F.hash("id"), F.lit(1000)) / 1000).cast("double")
    return ids.select(F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("g"), F.col("id").cast("double").alias("x"),
                      noise.alias("noise"), F.sqrt(F.col("id")).alias("time"))


def test_function_scores_high_and_noise_low(spark):
    scores = {(r["g"], r["feature"]): r["score"]
              for r in association.information_scores(frame(spark), ["g"], ["x", "noise"], "time").collect()}
    assert all(scores[g, "x"] > 0.99 for g in ("hot", "cold"))
    assert all(scores[g, "noise"] < 0.2 for g in ("hot", "cold"))
    kept = association.informative_features(
        association.information_scores(frame(spark), ["g"], ["x", "noise"], "time"), ["g"])
    assert {r["feature"] for r in kept.collect()} == {"x"}


def fine_bins(values, bins=association.BINS):
    ordered = np.sort(values)
    edges = [ordered[-(-k * len(ordered) // bins) - 1] for k in range(1, bins)]
    return np.searchsorted(edges, values, side="left")


def test_against_brute_force(spark):
    rows = frame(spark, 700).toPandas()
    found = {r["g"]: r["score"] for r in association.information_scores(frame(spark, 700), ["g"], ["noise"], "time").collect()}
    for group, part in rows.groupby("g"):
        n, best = len(part), 0.0
        x, y = fine_bins(part["noise"].to_numpy()), fine_bins(part["time"].to_numpy())
        for bx in range(2, association.BINS + 1):
            for by in range(2, association.BINS + 1):
                if bx * by > max(n ** 0.6, 4):
                    continue
                joint = np.zeros((bx, by))
                np.add.at(joint, (x * bx // association.BINS, y * by // association.BINS), 1 / n)
                outer = joint.sum(1)[:, None] * joint.sum(0)[None]
                seen = joint > 0
                best = max(best, (joint[seen] * np.log(joint[seen] / outer[seen])).sum() / np.log(min(bx, by)))
        assert abs(found[group] - best) < 1e-9


def test_rows_with_a_null_do_not_count(spark):
    gapped = frame(spark, 500).withColumn("x", F.when(F.col("x") % 5 != 0, F.col("x"))).withColumn(
        "time", F.when(F.col("x").isNull() | (F.col("x") % 7 != 0), F.col("time")))
    cells = association.joint_histograms(gapped, ["g"], ["x", "noise"], "time").groupBy("feature").agg(F.sum("n").alias("n"))
    assert {r["feature"]: r["n"] for r in cells.collect()} == {
        "x": gapped.where("x is not null and time is not null").count(), "noise": gapped.where("time is not null").count()}


def test_every_row_is_counted(spark):
    cells = association.joint_histograms(frame(spark, 999), ["g"], ["x", "noise"], "time")
    assert cells.groupBy("feature").agg(F.sum("n").alias("n")).where("n <> 999").count() == 0


def test_edges_with_a_hot_group_and_many_copies(spark):
    ids = spark.range(30_000)
    rows = ids.select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 20)).alias("g"),
                      F.when(F.col("id") % 5 == 0, 7.0).otherwise(F.pmod(F.hash("id"), F.lit(5000)).cast("double")).alias("v"))
    found = {r["g"]: r["edges"] for r in association.ranked_values(rows, ["g"], ["v"], 16).collect()}
    for group, part in rows.toPandas().groupby("g"):
        ordered = np.sort(part["v"].to_numpy())
        assert found[group] == [ordered[-(-k * len(ordered) // 16) - 1] for k in range(1, 16)]


def test_fewer_rows_than_bins(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", None)], "g string, v double")
    found = {r["g"]: r["edges"] for r in association.ranked_values(rows, ["g"], ["v"], 4).collect()}
    assert found == {"a": [1.0, 1.0, 2.0]}


# ---- grids whose lines move

def best_grid_by_hand(x, y):
    """All column cuts between distinct values, rows near even, either axis."""
    best = 0.0
    for a, b in ((x, y), (y, x)):
        values, own = np.unique(a, return_inverse=True)
        _, other, counts = np.unique(b, return_inverse=True, return_counts=True)
        n, allowed = len(a), max(4, max(c for c in range(1, len(a) + 5) if c ** 5 <= len(a) ** 3))
        for rows in range(2, allowed // 2 + 1):
            row = (rows * (2 * (np.cumsum(counts) - counts) + counts) // (2 * n))[other]
            for columns in range(2, allowed // rows + 1):
                for cuts in itertools.combinations(range(1, len(values)), columns - 1):
                    joint = np.zeros((columns, rows))
                    np.add.at(joint, (np.searchsorted(cuts, own, side="right"), row), 1 / n)
                    outer, seen = joint.sum(1)[:, None] * joint.sum(0)[None], joint > 0
                    best = max(best, (joint[seen] * np.log(joint[seen] / outer[seen])).sum() / np.log(min(rows, columns)))
    return best


def test_moved_lines_against_all_grids(spark):
    rng, rows = np.random.default_rng(4), []
    for group in range(40):
        n = int(rng.integers(2, 28))
        x = rng.integers(0, rng.integers(1, 30), n)
        rows += [(group, float(a), float(a * a % 7 + b)) for a, b in zip(x, rng.integers(0, 3, n), strict=True)]
    df = spark.createDataFrame(rows, "g int, x double, time double")
    by_rows = {r["g"]: r["score"] for r in association.maximal_information(df, ["g"], ["x"], "time").collect()}
    by_cells = {r["g"]: r["score"] for r in association.maximal_information(df, ["g"], ["x"], "time", small_group=0).collect()}
    for group in range(40):
        own = [(x, y) for g, x, y in rows if g == group]
        expected = best_grid_by_hand(*map(np.array, zip(*own, strict=True)))
        assert abs(by_rows[group] - expected) < 1e-9 and abs(by_cells[group] - expected) < 1e-9


def test_both_ways_to_moved_lines_agree(spark):
    df = frame(spark, 3000).withColumn("x", F.when(F.col("x") % 9 > 0, F.col("x") % 777))
    ways = [{(r["g"], r["feature"]): r["score"] for r in association.maximal_information(
        df, ["g"], ["x", "noise"], "time", small_group=size).collect()} for size in (4096, 0)]
    assert ways[0] == ways[1] and len(ways[0]) == 4
    even = {(r["g"], r["feature"]): r["score"] for r in association.information_scores(df, ["g"], ["x", "noise"], "time").collect()}
    assert all(ways[0][key] >= even[key] - 0.02 for key in even)


def test_moved_lines_reach_even_ones_on_every_group(spark):
    features = timemodel.model_features(views.runs(spark, "/root/testdata/sf0.01"), ["workload", "instance_type"])
    args = features, ["workload", "instance_type"], ["z1", "z3"], "time"
    even = {tuple(r)[:3]: r["score"] for r in association.information_scores(*args).collect()}
    moved = {tuple(r)[:3]: r["score"] for r in association.maximal_information(*args).collect()}
    assert len(even) == 18 and all(moved[key] > even[key] for key in even)


def test_moved_lines_of_empty_and_constant_columns(spark):
    rows = spark.createDataFrame([(1, 1.0, None, 2.0), (1, 1.0, None, 3.0), (None, 2.0, 1.0, 1.0), (None, 3.0, 1.0, 2.0)],
                                 "g int, x double, z double, time double")
    got = {(r["g"], r["feature"]): r["score"] for r in association.maximal_information(rows, ["g"], ["x", "z"], "time").collect()}
    assert got == {(1, "x"): 0.0, (None, "x"): 1.0, (None, "z"): 0.0}
    assert association.maximal_information(rows.where("false"), ["g"], ["x"], "time").count() == 0


def test_a_task_holds_one_group_at_a_time(spark):
    """Batches of ten thousand groups with their joint counts are gigabytes."""
    key = (1 << 60) + 1
    rows = spark.createDataFrame([(key, float(i % 5), float(i % 5)) for i in range(20)] + [(None, 1.0, 2.0)],
                                 "g bigint, x double, time double")
    for score in (association.information_scores, association.maximal_information,
                  lambda *args: association.maximal_information(*args, small_group=0)):
        scored = score(rows, ["g"], ["x"], "time")
        plan = scored._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroupsInArrow" in plan and "MapInPandas" not in plan
        assert {(r["g"], r["feature"]) for r in scored.collect()} == {(key, "x"), (None, "x")}
