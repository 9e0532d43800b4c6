"""Experiment design: which (input fraction, machines) runs to do under a budget.

A design problem is one row of parameters (``PROBLEM``). Problems that share
all parameters share their answer, so weights are found once per distinct
parameter row and joined back. Small designs are solved whole, many in
parallel; designs with more candidates than ``LOCAL_CANDIDATES`` are solved in
rounds of grouped sums over packed blocks of candidates.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial, reduce
from itertools import combinations_with_replacement
from operator import and_

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runcast.functions import optimum, solvers
from runcast.functions.features import DESIGN_TERMS, design_terms
from runcast.operators.keyed import attach
from runcast.session import materialize, spread

# fixed values of a problem row that leaves them out
DEFAULT_MIN_MACHINES = 1
DEFAULT_MAX_MACHINES = 16
DEFAULT_CORES_PER_MACHINE = 2
DEFAULT_BUDGET = 10.0
DEFAULT_STEPS = 16
MIN_WEIGHT = 0.1

PROBLEM = ["min_parts", "max_parts", "total_parts", "min_machines", "max_machines", "cores_per_machine",
           "budget", "steps"]
INFORMATION = [f"m_{i}_{j}" for i, j in combinations_with_replacement(range(6), 2)]
LOCAL_CANDIDATES = 10_000
BLOCK_SIDE = 64
TRIALS = 4
WARM_CANDIDATES = 2_000
WARM_MU = 1e-4


def with_defaults(problems: DataFrame) -> DataFrame:
    """Fill absent problem columns with the fixed defaults."""
    defaults = {"min_machines": DEFAULT_MIN_MACHINES, "max_machines": DEFAULT_MAX_MACHINES,
                "cores_per_machine": DEFAULT_CORES_PER_MACHINE, "budget": DEFAULT_BUDGET, "steps": DEFAULT_STEPS}
    missing = {name: F.lit(value) for name, value in defaults.items() if name not in problems.columns}
    return problems.withColumns(missing) if missing else problems


def _share(parts: str) -> Column:
    return F.col(parts).cast("double") / F.col("total_parts")


def fraction_grid(problems: DataFrame) -> DataFrame:
    """Add ``step`` and ``fraction``: evenly spaced, both ends included, one point if steps is 1."""
    gap = (_share("max_parts") - _share("min_parts")) / F.nullif(F.col("steps") - 1, F.lit(0))
    steps = problems.withColumn("step", F.explode(F.sequence(F.lit(0), F.col("steps") - 1)))
    return steps.withColumn("fraction", _share("min_parts") + F.coalesce(F.col("step") * gap, F.lit(0.0)))


def machine_grid(problems: DataFrame) -> DataFrame:
    """Add ``machine``, from the least to the largest count."""
    return problems.withColumn("machine", F.explode(F.sequence(F.col("min_machines"), F.col("max_machines"))))


def candidates(problems: DataFrame, *, large: bool = False) -> DataFrame:
    """Every (fraction, machine) with at least one partition per core, and what a run of it costs.

    Problems are spread before they fan out; ``large`` ones also between machines and fractions.
    """
    machines = machine_grid(spread(with_defaults(problems)))
    grid = fraction_grid(spread(machines) if large else machines)
    enough = F.rint(F.col("fraction") * F.col("total_parts")) >= F.col("cores_per_machine") * F.col("machine")
    return grid.where(enough).withColumn("cost", F.col("fraction") / _share("min_parts") / F.col("machine"))


def design_features(rows: DataFrame) -> DataFrame:
    """Add the six design terms."""
    cores = F.col("machine") * F.col("cores_per_machine")
    return rows.withColumns(design_terms(cores, F.col("machine"), F.col("fraction")))


def column_means(features: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean of each design term per group."""
    return features.groupBy(*keys).agg(*[F.avg(x).alias(f"mean_{x}") for x in DESIGN_TERMS])


def _divisor(mean: str) -> str:
    return f"coalesce(nullif({mean}, 0D), 1D)"


def normalized(features: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Design terms over their group's mean; a term whose mean is 0 stays as it is."""
    joined = attach(features, column_means(features, keys), keys)
    scaled = {x: F.expr(f"{x} / {_divisor(f'mean_{x}')}") for x in DESIGN_TERMS}
    return joined.withColumns(scaled).drop(*[f"mean_{x}" for x in DESIGN_TERMS])


def information(features: DataFrame, keys: Sequence[str], weight: str) -> DataFrame:
    """Upper triangle of ``sum w x x'`` over mean-scaled terms, the candidate count and the total cost.

    The scaling is divided out of the sums, so one pass does and no row is joined.
    """
    cells = list(combinations_with_replacement(range(6), 2))
    sums = [f"sum({weight} * x{i} * x{j}) AS m_{i}_{j}" for i, j in cells]
    means = [f"avg({x}) AS mean_{x}" for x in DESIGN_TERMS]
    grouped = features.groupBy(*keys).agg(*[F.expr(s) for s in [
        "count(1) AS n", f"sum({weight} * cost) AS cost", *sums, *means]])
    scaled = {f"m_{i}_{j}": F.expr(f"m_{i}_{j} / {_divisor(f'mean_x{i}')} / {_divisor(f'mean_x{j}')}")
              for i, j in cells}
    return grouped.withColumns(scaled)


def _objective_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        full = solvers.symmetric(batch[INFORMATION].to_numpy(dtype=float), 6)
        spectrum = np.linalg.eigvalsh(full)
        regular = spectrum[:, 0] > 1e-13 * spectrum[:, -1]
        inverse = np.full_like(full, np.nan)
        inverse[regular] = np.linalg.inv(full[regular])
        log_det = np.where(regular, np.linalg.slogdet(np.where(regular[:, None, None], full, np.eye(6)))[1], -np.inf)
        trace = np.where(regular, np.einsum("gii->g", inverse), np.inf)
        yield batch.assign(log_det=log_det, inverse_trace=trace, inverse=list(inverse.reshape(-1, 36)),
                           inverse_squared=list((inverse @ inverse).reshape(-1, 36)))


def objectives(informations: DataFrame) -> DataFrame:
    """Add ``log_det`` (D criterion), ``inverse_trace`` (A criterion), the ``inverse`` matrix and its square."""
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in informations.schema.fields]
    schema = ", ".join([*fields, "log_det double", "inverse_trace double", "inverse array<double>",
                        "inverse_squared array<double>"])
    return informations.mapInPandas(_objective_batches, schema)


def run_cost(weighted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cost of a weighted design: ``sum w (fraction / least fraction) / machine``."""
    return weighted.groupBy(*keys).agg(F.sum(F.col("weight") * F.col("cost")).alias("cost"))


def constraint_check(weighted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Largest violation of ``0 <= w <= 1`` and of the budget per group (0 when kept)."""
    outside = F.greatest(-F.col("weight"), F.col("weight") - 1.0, F.lit(0.0))
    spent = F.sum(F.col("weight") * F.col("cost"))
    return weighted.groupBy(*keys).agg(
        F.max(outside).alias("bound_violation"),
        F.greatest(spent - F.first("budget"), F.lit(0.0)).alias("budget_violation"))


def optimality_gap(weighted: DataFrame, keys: Sequence[str], criterion: str = "D") -> DataFrame:
    """Objective, cost and a proven bound on how far the objective is from the best one.

    For any budget price q the best objective is better than this one by at
    most ``q B + sum max(0, d - q c) - sum w d``, where d is ``x' M^-1 x`` for "D"
    and ``x' M^-2 x`` for "A"; q is read off the candidates with fractional weight.
    """
    features = design_features(weighted)
    found = objectives(information(features, keys, "weight"))
    leverage, objective = ("inverse", "log_det") if criterion == "D" else ("inverse_squared", "inverse_trace")
    joined = attach(features, found.select(*keys, F.col(objective).alias("objective"), leverage,
                                           F.col("cost").alias("spent"), *[f"mean_x{i}" for i in range(6)]), keys)
    scaled = [f"(x{i} / {_divisor(f'mean_x{i}')})" for i in range(6)]
    lever = F.expr(" + ".join(f"get({leverage}, {6 * i + j}) * {scaled[i]} * {scaled[j]}"
                              for i in range(6) for j in range(6)))
    carried = [c for c in ["weight", "cost", "budget", "spent", "objective"] if c not in keys]
    levered = materialize(joined.select(*keys, *carried, lever.alias("lever")), "levers")
    fractional = F.col("weight") * (1 - F.col("weight"))
    price = levered.groupBy(*keys).agg(
        (F.sum(fractional * F.col("lever") / F.col("cost")) / F.nullif(F.sum(fractional), F.lit(0.0))).alias("price"))
    priced = attach(levered, price.withColumn("price", F.coalesce("price", F.lit(0.0))), keys)
    surplus = F.sum(F.greatest(F.col("lever") - F.col("price") * F.col("cost"), F.lit(0.0)))
    bound = F.first("price") * F.first("budget") + surplus - F.sum(F.col("weight") * F.col("lever"))
    regular = F.abs(F.first("objective")) < float("inf")
    return priced.groupBy(*keys).agg(F.first("objective").alias("objective"), F.first("spent").alias("cost"),
                                     F.when(regular, bound).alias("gap"))


_LOCAL_COLUMNS = ["step", "machine", "fraction", "cost"]
_LOCAL_SCHEMA = "step int, machine int, fraction double, cost double, weight double, status string"


def _types(df: DataFrame, columns: Sequence[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def _solve_design(group: pd.DataFrame, criterion: str) -> pd.DataFrame:
    found, status = optimum.solve(group[DESIGN_TERMS].to_numpy(dtype=float), group["cost"].to_numpy(dtype=float),
                                  float(group["budget"].iloc[0]), criterion)
    return group[[*PROBLEM, *_LOCAL_COLUMNS]].assign(weight=found, status=status)


def _weights_whole(problems: DataFrame, criterion: str) -> DataFrame:
    features = spread(design_features(candidates(problems)), *PROBLEM)
    schema = f"{_types(features, PROBLEM)}, {_LOCAL_SCHEMA}"
    return features.groupBy(*PROBLEM).applyInPandas(
        lambda group: _solve_design(group, criterion), schema)


# one row per design; arrays are flattened matrices
_STATE_SCHEMA = ("basis array<double>, root array<double>, points array<double>, point array<double>, step_taken array<double>, "
                 "length double, value double, fall double, mu double, rounds int, status string")
_STATE_COLUMNS = ["basis", "root", "points", "point", "step_taken", "length", "value", "fall", "mu", "rounds", "status"]


def _state_of(row) -> dict:
    points = np.asarray(row.points, dtype=float).reshape(-1, optimum.UNKNOWNS)
    return {"basis": np.asarray(row.basis, dtype=float).reshape(6, 6),
            "root": np.asarray(row.root, dtype=float).reshape(6, 6), "points": points,
            "point": np.asarray(row.point, dtype=float), "step": np.asarray(row.step_taken, dtype=float),
            "length": row.length, "value": row.value, "fall": row.fall, "mu": row.mu, "budget": row.budget,
            "rounds": int(row.rounds), "status": row.status}


def _row_of(state: dict) -> list:
    return [state["basis"].ravel(), state["root"].ravel(), np.ravel(state["points"]), state["point"], state["step"], state["length"],
            state["value"], state["fall"], state["mu"], state["rounds"], state["status"]]


def _with_states(batch: pd.DataFrame, states: list[dict], keep: Sequence[str]) -> pd.DataFrame:
    added = pd.DataFrame([_row_of(s) for s in states], columns=_STATE_COLUMNS, index=batch.index)
    return pd.concat([batch[list(keep)], added], axis=1)


def _start_batches(batches: Iterator[pd.DataFrame], criterion: str) -> Iterator[pd.DataFrame]:
    for batch in batches:
        full = solvers.symmetric(batch[INFORMATION].to_numpy(dtype=float), 6)
        means = batch[[f"mean_x{i}" for i in range(6)]].to_numpy(dtype=float)
        states = []
        for row, matrix, mean in zip(batch.itertuples(index=False), full, means):
            state = optimum.start(matrix, row.cost, row.budget, criterion)
            # the blocks hold raw terms: the scaling by means goes into the basis
            state["basis"] = state["basis"] / np.where(mean == 0, 1.0, mean)[:, None]
            states.append(state)
        yield _with_states(batch, states, [*PROBLEM, "n"])


def _warm_design(group: pd.DataFrame, criterion: str) -> pd.DataFrame:
    """Advance a design on a thinned candidate set whose sums stand for all of them."""
    first = group.iloc[[0]]
    state = _state_of(next(first.itertuples(index=False)))
    x = group[DESIGN_TERMS].to_numpy(dtype=float)
    cost = group["cost"].to_numpy(dtype=float)
    share = float(first["n"].iloc[0]) / len(group)
    while state["status"] == "running":
        sums = share * optimum.candidate_sums(x @ state["basis"], cost, state["points"], state["mu"])
        state = optimum.advance(state, sums, last_mu=WARM_MU, criterion=criterion)
    state |= {"status": "running", "value": np.inf, "fall": 0.0, "points": state["point"][None]}
    return _with_states(first, [state], [*PROBLEM, "n"])


def _block_arrays(row) -> tuple[np.ndarray, np.ndarray]:
    x = np.asarray(row.terms, dtype=float).reshape(-1, 6) @ np.asarray(row.basis, dtype=float).reshape(6, 6)
    return x, np.asarray(row.costs, dtype=float)


def _sum_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sums = []
        for row in batch.itertuples(index=False):
            points = np.asarray(row.points, dtype=float).reshape(-1, optimum.UNKNOWNS)
            sums.append(optimum.candidate_sums(*_block_arrays(row), points, row.mu).ravel())
        yield batch[PROBLEM].assign(sums=sums)


def _advance_batches(batches: Iterator[pd.DataFrame], criterion: str) -> Iterator[pd.DataFrame]:
    for batch in batches:
        states = []
        for row in batch.itertuples(index=False):
            sums = np.asarray(row.sums, dtype=float).reshape(-1, optimum.SUMS)
            states.append(optimum.advance(_state_of(row), sums, trials=TRIALS, criterion=criterion))
        yield _with_states(batch, states, [*PROBLEM, "n"])


def _weight_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = []
        for row in batch.itertuples(index=False):
            if row.status == "all":
                found.append(np.ones(len(row.costs)))
            elif row.status == "singular":
                found.append(np.full(len(row.costs), np.nan))
            else:
                found.append(optimum.weights(*_block_arrays(row), np.asarray(row.point, dtype=float), row.mu))
        yield batch[[*PROBLEM, "steps_at", "machines_at", "fractions", "costs", "status"]].assign(weights=found)


def _blocks(features: DataFrame) -> DataFrame:
    """Candidates packed by grid tile, at most ``BLOCK_SIDE`` squared in a row."""
    tile = [F.floor(F.col("step") / BLOCK_SIDE).alias("tile_step"),
            F.floor(F.col("machine") / BLOCK_SIDE).alias("tile_machine")]
    entry = F.struct("step", "machine", "fraction", "cost", F.array(*DESIGN_TERMS).alias("terms"))
    packed = features.groupBy(*PROBLEM, *tile).agg(F.collect_list(entry).alias("entries"))
    return packed.select(*PROBLEM, F.col("entries.step").alias("steps_at"),
                         F.col("entries.machine").alias("machines_at"),
                         F.col("entries.fraction").alias("fractions"), F.col("entries.cost").alias("costs"),
                         F.flatten("entries.terms").alias("terms"))


def _weights_in_rounds(problems: DataFrame, criterion: str) -> DataFrame:
    features = design_features(candidates(problems, large=True))
    blocks = materialize(_blocks(features), "design-blocks")
    key_types = _types(blocks, PROBLEM)
    state_schema = f"{key_types}, n bigint, {_STATE_SCHEMA}"
    totals = information(features, PROBLEM, "1D")
    states = materialize(totals.mapInPandas(partial(_start_batches, criterion=criterion), state_schema), "design-states")
    closed = states.where("status != 'running'")

    place = F.pmod(F.xxhash64("step", "machine"), F.ceil(F.col("n") / WARM_CANDIDATES))
    thinned = attach(features, states.where("status = 'running'"), PROBLEM, stored=True, how="inner").where(place == 0)
    warm = materialize(thinned.groupBy(*PROBLEM).applyInPandas(
        lambda group: _warm_design(group, criterion), state_schema), "design-states")
    # a design whose thinned set is empty starts from its full sums instead
    states = warm.unionByName(states.where("status = 'running'").join(warm.select(*PROBLEM), PROBLEM, "left_anti"))

    while True:
        running = states.where("status = 'running'")
        if running.isEmpty():
            break
        partial_sums = attach(blocks, running, PROBLEM, stored=True, how="inner").mapInPandas(_sum_batches, f"{key_types}, sums array<double>")
        total = Summarizer.sum(array_to_vector("sums"))
        summed = partial_sums.groupBy(*PROBLEM).agg(vector_to_array(total).alias("sums"))
        advanced = running.join(summed, PROBLEM).mapInPandas(
            partial(_advance_batches, criterion=criterion), state_schema)
        states = materialize(advanced.union(states.where("status != 'running'")), "design-states")

    schema = (f"{key_types}, steps_at array<int>, machines_at array<int>, fractions array<double>, "
              "costs array<double>, status string, weights array<double>")
    found = attach(blocks, states.union(closed), PROBLEM).mapInPandas(_weight_batches, schema)
    rows = found.select(*PROBLEM, "status",
                        F.explode(F.arrays_zip("steps_at", "machines_at", "fractions", "costs", "weights")).alias("c"))
    rows = materialize(rows.select(*PROBLEM, F.col("c.steps_at").alias("step"), F.col("c.machines_at").alias("machine"),
                                   F.col("c.fractions").alias("fraction"), F.col("c.costs").alias("cost"),
                                   F.col("c.weights").alias("weight"), "status"), "design-weights")
    fit = F.when(F.col("spent") > F.col("budget"), F.col("budget") / F.col("spent")).otherwise(F.lit(1.0))
    spent = run_cost(rows, PROBLEM).withColumnRenamed("cost", "spent")
    return attach(rows, spent, PROBLEM).withColumn("weight", F.when(F.col("status") == "all", F.col("weight"))
                                                   .otherwise(F.col("weight") * fit)).drop("spent")


def distinct_problems(problems: DataFrame) -> DataFrame:
    """The different parameter rows, each once."""
    return with_defaults(problems).select(*PROBLEM).distinct()


def optimal_weights(problems: DataFrame, *, criterion: str = "D", local_candidates: int = LOCAL_CANDIDATES) -> DataFrame:
    """Weight of every candidate of every distinct problem, with the solver's status, as a written table.

    ``criterion`` is "D" or "A". ``status`` is "done", "all" (the budget covers every candidate), "singular"
    (no invertible matrix exists; weights are null) or "stalled".
    """
    shapes = materialize(distinct_problems(problems), "problems")
    most = F.col("steps").cast("bigint") * (F.col("max_machines") - F.col("min_machines") + 1)
    found = _weights_whole(shapes.where(most <= local_candidates), criterion)
    large = shapes.where(most > local_candidates)
    if not large.isEmpty():
        found = found.unionByName(_weights_in_rounds(large, criterion))
    return materialize(found.withColumn("weight", F.when(~F.isnan("weight"), F.col("weight"))), "weights")


def parts_of(fraction: Column, total_parts: Column) -> Column:
    """Partitions that make up a fraction of the input."""
    return F.ceil(fraction * total_parts).cast("int")


def chosen_runs(weighted: DataFrame, keys: Sequence[str], min_weight: float = MIN_WEIGHT) -> DataFrame:
    """The design proper: candidates above ``min_weight`` with their ``position``, heaviest first within each group.

    The order is within a design, so designs stay where their key puts them: no global sort.
    """
    chosen = weighted.where(F.col("weight") > min_weight)
    heaviest = Window.partitionBy(*keys).orderBy(F.desc("weight"), "machine", "fraction")  # a few dozen runs
    return chosen.select(*keys, parts_of(F.col("fraction"), F.col("total_parts")).alias("parts"), "fraction",
                         "machine", "weight", F.row_number().over(heaviest).alias("position"))


def design_runs(problems: DataFrame, keys: Sequence[str], *, criterion: str = "D",
                local_candidates: int = LOCAL_CANDIDATES) -> DataFrame:
    """Design every problem; the solved shapes are joined back to the problems that share them.

    Every problem has a row at least: ``status`` tells how the solver ended, and a problem without a design
    ("singular", "none" without candidates) has one row of null runs.
    """
    problems = with_defaults(problems)
    found = optimal_weights(problems, criterion=criterion, local_candidates=local_candidates)
    status = found.groupBy(*PROBLEM).agg(F.first("status").alias("status"))
    solved = found.where(F.col("weight") > MIN_WEIGHT).select(*PROBLEM, "fraction", "machine", "weight")
    told = attach(problems.select(*keys, *PROBLEM), status, PROBLEM)
    chosen = chosen_runs(problems.select(*keys, *PROBLEM).join(solved, PROBLEM), keys)
    return attach_runs(told.select(*keys, F.coalesce("status", F.lit("none")).alias("status")), chosen, keys)


def attach_runs(told: DataFrame, chosen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All runs of each problem beside its status; null keys match."""
    own = {key: f"_{key}_of_run" for key in keys}
    renamed = chosen.select(*[F.col(c).alias(own.get(c, c)) for c in chosen.columns])
    same = reduce(and_, [told[key].eqNullSafe(renamed[own[key]]) for key in keys])
    return told.join(renamed, same, "left").drop(*own.values())


def design_report(chosen: DataFrame) -> DataFrame:
    """One printable line per run: machines, input fraction, weight."""
    return chosen.withColumn("line", F.format_string("%d, %f, %f", "machine", "fraction", "weight"))
