import numpy as np
import pytest
from pyspark.sql import functions as F

from runcast.functions import optimum
from runcast.operators import design
from runcast.plans import design_queries

SCHEMA = ("min_parts int, max_parts int, total_parts int, min_machines int, max_machines int, "
          "cores_per_machine int, budget double, steps int")
SMALL = (3, 20, 256, 1, 8, 2, 10.0, 16)
# optimum of SMALL found by two independent methods: (cores, fraction) -> weight
KNOWN = {
    (16, 0.069271): 1, (16, 0.064844): 1, (12, 0.047135): 1, (10, 0.038281): 1, (6, 0.025): 1, (4, 0.016146): 1,
    (2, 0.011719): 1, (2, 0.029427): 0.740174, (12, 0.051562): 0.486187, (4, 0.020573): 0.391371,
    (16, 0.073698): 0.379453, (2, 0.078125): 0.283002, (8, 0.029427): 0.162533,
}
# fixed values: a plan drawn up elsewhere with unstated parameters, for a soft comparison
PLAN = [(16, 0.069271), (12, 0.047135), (16, 0.064844), (10, 0.038281), (2, 0.011719), (4, 0.016146), (2, 0.029427),
        (4, 0.020573), (8, 0.029427), (10, 0.042708), (16, 0.073698), (2, 0.078125), (4, 0.078125)]


def problems(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def weights_of(rows):
    return {(2 * r["machine"], int(r["fraction"] * 1e6 + 0.5 - 1e-6) / 1e6): r["weight"] for r in rows}


def test_candidate_count(spark):
    assert design.candidates(problems(spark, SMALL)).count() == 84


def test_rounding_is_half_to_even(spark):
    # 2.5 partitions round to 2, too few for 3 cores; 3.5 round to 4
    grid = design.candidates(problems(spark, (5, 7, 20, 1, 1, 3, 1.0, 2)).withColumn(
        "total_parts", F.lit(10)).withColumn("min_parts", F.lit(0.25 * 10)).withColumn("max_parts", F.lit(0.35 * 10)))
    assert [round(r["fraction"], 2) for r in grid.collect()] == [0.35]


def test_single_step_grid_is_the_lowest_fraction(spark):
    rows = design.fraction_grid(problems(spark, (3, 20, 256, 1, 1, 2, 10.0, 1))).collect()
    assert [r["fraction"] for r in rows] == [3 / 256]


def test_defaults(spark):
    bare = spark.createDataFrame([(3, 20, 256)], "min_parts int, max_parts int, total_parts int")
    row = design.with_defaults(bare).first()
    assert (row["min_machines"], row["max_machines"], row["cores_per_machine"], row["budget"], row["steps"]) == (
        1, 16, 2, 10.0, 16)


def test_known_optimum(spark):
    found = weights_of(design.optimal_weights(problems(spark, SMALL)).where("weight > 0.1").collect())
    assert set(found) == set(KNOWN)
    assert all(abs(found[k] - w) < 2e-3 for k, w in KNOWN.items())
    assert len(set(found) & set(PLAN)) >= 11


def test_design_rows(spark):
    rows = design.design_runs(problems(spark, SMALL).withColumn("workload", F.lit("w")), ["workload"]).collect()
    rows = sorted(rows, key=lambda r: r["position"])
    assert [r["position"] for r in rows] == list(range(1, len(rows) + 1)) and {r["status"] for r in rows} == {"done"}
    assert [r["weight"] for r in rows] == sorted((r["weight"] for r in rows), reverse=True)
    assert all(r["parts"] == int(np.ceil(r["fraction"] * 256)) for r in rows)
    lines = design.design_report(spark.createDataFrame(rows)).select("line").collect()
    assert lines[0]["line"].count(",") == 2


def test_large_budget_takes_everything(spark):
    rows = design.optimal_weights(problems(spark, SMALL[:6] + (1e6, 16))).collect()
    assert {r["weight"] for r in rows} == {1.0} and {r["status"] for r in rows} == {"all"}


@pytest.mark.parametrize("local", [10_000, 10])
def test_one_machine_has_no_design(spark, local):
    rows = design.optimal_weights(problems(spark, (3, 20, 256, 1, 1, 2, 10.0, 16)), local_candidates=local).collect()
    assert {r["status"] for r in rows} == {"singular"} and {r["weight"] for r in rows} == {None}


@pytest.mark.parametrize("criterion", ["D", "A"])
def test_rounds_agree_with_whole_solution(spark, criterion):
    rows = [SMALL, (3, 30, 256, 1, 6, 2, 5.0, 20), (3, 20, 256, 1, 8, 2, 1e6, 16)]
    by_rounds = design.optimal_weights(problems(spark, *rows), criterion=criterion, local_candidates=10)
    whole = design.optimal_weights(problems(spark, *rows), criterion=criterion)
    keys = [*design.PROBLEM, "step", "machine"]
    joined = whole.alias("a").join(by_rounds.withColumnRenamed("weight", "other").alias("b"), keys)
    assert joined.count() == whole.count() == by_rounds.count()
    assert joined.agg(F.max(F.abs(F.col("weight") - F.col("other")))).first()[0] < 1e-4
    for found in (whole, by_rounds):
        check = design.constraint_check(found, design.PROBLEM).agg(F.max("bound_violation"), F.max("budget_violation"))
        assert max(check.first()) < 1e-9
        gaps = design.optimality_gap(found.where("status = 'done'"), design.PROBLEM, criterion).collect()
        assert all(-1e-6 <= g["gap"] < 1e-3 * abs(g["objective"]) for g in gaps) and len(gaps) == 2


def test_every_problem_has_a_row(spark):
    asked = problems(spark, SMALL, (3, 20, 256, 1, 1, 2, 10.0, 16), (3, 20, 256, 99, 99, 2, 10.0, 16))
    asked = asked.withColumn("workload", F.when(F.col("max_machines") < 99, F.col("max_machines").cast("string")))
    rows = design.design_runs(asked, ["workload"]).collect()
    assert {(r["workload"], r["status"]) for r in rows} == {("8", "done"), ("1", "singular"), (None, "none")}
    assert all(r["weight"] is None for r in rows if r["status"] != "done")


def test_several_tiles_agree_with_whole_solution(spark):
    """150 x 70 grid: six tiles, on the route of rounds and in one piece."""
    large = problems(spark, (100, 900, 2048, 1, 70, 2, 30.0, 150))
    whole = design.optimal_weights(large, local_candidates=1_000_000)
    by_rounds = design.optimal_weights(large, local_candidates=10)
    joined = whole.join(by_rounds.withColumnRenamed("weight", "other"), [*design.PROBLEM, "step", "machine"])
    assert joined.count() == whole.count() == by_rounds.count()
    assert joined.agg(F.max(F.abs(F.col("weight") - F.col("other")))).first()[0] < 1e-4


def features(parameters):
    low, high, total, first, last, cores, budget, steps = parameters
    grid = [(f, m) for f in np.linspace(low / total, high / total, steps) for m in range(first, last + 1)
            if np.rint(f * total) >= cores * m]
    f, m = np.array(grid).T
    c = cores * m
    x = np.stack([np.ones_like(f), f / c, np.sqrt(f) / c, m, np.log(m), m * m], axis=1)
    return x, f / (low / total) / m, budget


@pytest.mark.parametrize("criterion", ["D", "A"])
@pytest.mark.parametrize("parameters", [
    SMALL, (3, 20, 256, 1, 16, 2, 5.0, 16), (3, 20, 256, 1, 8, 2, 100.0, 16), (3, 20, 256, 1, 4, 2, 10.0, 16),
    (16, 64, 256, 1, 16, 4, 5.0, 20)])
def test_multiplicative_method_agrees(parameters, criterion):
    """An independent method: weights grow with leverage over cost, the price found by bisection."""
    x, cost, budget = features(parameters)
    found, status = optimum.solve(x, cost, budget, criterion)
    assert status == "done"
    x = x / x.mean(0)
    w = np.full(len(cost), budget / cost.sum())
    for _ in range(3000):
        inverse = np.linalg.inv((x * w[:, None]).T @ x)
        lever = ((x @ (inverse if criterion == "D" else inverse @ inverse)) * x).sum(1)
        low, high = 1e-9, 1e12
        for _ in range(60):
            price = np.sqrt(low * high)
            ratio = lever / (price * cost)
            trial = np.minimum(1, w * (ratio if criterion == "D" else np.sqrt(ratio)))
            low, high = (price, high) if trial @ cost > budget else (low, price)
        ratio = lever / (high * cost)
        w = np.minimum(1, w * (ratio if criterion == "D" else np.sqrt(ratio)))

    def objective(weights):
        matrix = (x * weights[:, None]).T @ x
        return np.linalg.slogdet(matrix)[1] if criterion == "D" else -np.log(np.trace(np.linalg.inv(matrix)))

    assert objective(found) > objective(w) - 1e-3
    assert objective(found) < objective(w) + 2e-2
    assert found.min() >= 0 and found.max() <= 1 and found @ cost <= budget * (1 + 1e-12)


def test_shared_shapes_are_solved_once(spark):
    many = problems(spark, SMALL).crossJoin(spark.range(50).withColumnRenamed("id", "workload"))
    assert design.distinct_problems(many).count() == 1
    assert design.design_runs(many, ["workload"]).count() == 50 * 13


def test_scaling_leaves_a_zero_mean_term_alone(spark):
    rows = design.design_features(design.candidates(problems(spark, (3, 20, 256, 1, 1, 2, 10.0, 4))))
    scaled = design.normalized(rows, design.PROBLEM)
    assert {r["x4"] for r in scaled.collect()} == {0.0}


def test_objectives_of_a_singular_matrix(spark):
    rows = design.design_features(design.candidates(problems(spark, (3, 20, 256, 1, 1, 2, 10.0, 4))))
    row = design.objectives(design.information(rows, design.PROBLEM, "1D")).first()
    assert row["log_det"] == float("-inf") and row["inverse_trace"] == float("inf")


def test_candidates_of_all_problems_are_not_broadcast(spark, tmp_path):
    """They fan out from the problems, so that Spark takes them for as small as those."""
    rows = [(key, 1 + key % 50) for key in range(200)]
    spark.createDataFrame(rows, "p_partkey bigint, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    checked = design_queries.design_weights(spark, str(tmp_path))
    assert "Broadcast" not in checked._jdf.queryExecution().executedPlan().toString()
    told = checked.collect()
    assert len(told) == 200 and all(r["from_candidates"] and r["within_budget"] and r["in_order"] for r in told)
