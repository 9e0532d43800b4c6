"""From predictions to a decision: other instance types, cost, choice, accuracy."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runcast.operators.ordered import as_of_join, frontier


def transfer_factors(runs: DataFrame, base_scored: str, keys: Sequence[str]) -> DataFrame:
    """Scale from base predictions to the times of each group: least squares through the origin."""
    base = F.col(base_scored)
    return runs.groupBy(*keys).agg((F.sum(F.col("time") * base) / F.nullif(F.sum(base * base), F.lit(0.0))).alias("factor"))


def transferred(base_predictions: DataFrame, factors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Base predictions times the factor of every instance type of the same workload.

    A workload without a factor keeps its rows, with a null time. Null keys match.
    """
    own = {key: f"_{key}_of_factor" for key in keys}
    renamed = factors.select(*[F.col(c).alias(own.get(c, c)) for c in factors.columns])
    same = reduce(and_, [base_predictions[key].eqNullSafe(renamed[own[key]]) for key in keys])
    joined = base_predictions.join(renamed, same, "left").drop(*own.values())
    return joined.withColumn("time", F.col("time") * F.col("factor"))


def run_price(time: Column, machine: Column, hourly_price: Column) -> Column:
    """Cost of a run: hours times machines times the hourly price of one."""
    return time / 3600 * machine * hourly_price


def priced(predictions: DataFrame, prices: DataFrame, keys: Sequence[str] = ("instance_type",)) -> DataFrame:
    """Add ``cost`` from a price table ``(instance_type, hourly_price)``; null where no price is known.

    A configuration without a cost is left out by the choices below, not here.
    """
    joined = predictions.join(prices, list(keys), "left")
    return joined.withColumn("cost", run_price(F.col("time"), F.col("machine"), F.col("hourly_price")))


def _least(options: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The least row per key: every partition keeps its own least rows, only those are shuffled."""
    rest = [c for c in options.columns if c not in (*keys, *order)]
    best = options.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("best"))
    return best.select(*keys, "best.*")


def cheapest_within_deadline(options: DataFrame, keys: Sequence[str], deadline: float | Column) -> DataFrame:
    """Least cost among configurations with a cost whose time keeps the deadline; ties by time, then machines."""
    return _least(options.where((F.col("time") <= deadline) & F.col("cost").isNotNull()), keys, ["cost", "time", "machine"])


def fastest_within_budget(options: DataFrame, keys: Sequence[str], budget: float | Column) -> DataFrame:
    """Least time among configurations whose cost keeps the budget; ties by cost, then machines."""
    return _least(options.where(F.col("cost") <= budget), keys, ["time", "cost", "machine"])


def pareto_configs(options: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The configurations that no other one of the same keys beats in both time and cost."""
    return frontier(options, keys, "time", "cost")


def _for_limits(options: DataFrame, limits: DataFrame, keys: Sequence[str], limit: str, along: str, other: str) -> DataFrame:
    best = frontier(options, keys, along, other)
    return as_of_join(limits, best, keys, limit, along, [c for c in options.columns if c not in keys])


def cheapest_for_deadlines(options: DataFrame, deadlines: DataFrame, keys: Sequence[str], deadline: str) -> DataFrame:
    """Every row of ``deadlines`` with its cheapest configuration in time, or nulls where none is.

    On the frontier cost falls as time rises, so the last configuration before a deadline is the cheapest: one
    frontier answers all deadlines of a key.
    """
    return _for_limits(options, deadlines, keys, deadline, "time", "cost")


def fastest_for_budgets(options: DataFrame, budgets: DataFrame, keys: Sequence[str], budget: str) -> DataFrame:
    """Every row of ``budgets`` with its fastest configuration for the money, or nulls where none is."""
    return _for_limits(options, budgets, keys, budget, "cost", "time")


def prediction_accuracy(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean absolute relative error of ``predicted`` against the measured ``time``."""
    error = F.abs(F.col("predicted") - F.col("time")) / F.nullif(F.col("time"), F.lit(0.0))
    return scored.groupBy(*keys).agg(F.avg(error).alias("relative_error"), F.count(F.lit(1)).alias("n"))
