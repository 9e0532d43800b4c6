"""Elastic-net paths for many groups at once, from one pass of mergeable moments."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runcast.operators.keyed import attach

MIX = 0.8
TOLERANCE, MOST_SWEEPS = 1e-13, 50_000


def moments(df: DataFrame, keys: Sequence[str], columns: Sequence[str], target: str) -> DataFrame:
    """Count, means and population covariances per group, of rows in which all columns and the target have a value."""
    every = [*columns, target]
    complete = df.dropna(subset=every)
    means = [F.avg(c).alias(f"mean_{i}") for i, c in enumerate(every)]
    covariances = [F.covar_pop(every[i], every[j]).alias(f"cov_{i}_{j}")
                   for i, j in combinations_with_replacement(range(len(every)), 2)]
    return complete.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *means, *covariances)


def descend(correlation: np.ndarray, with_target: np.ndarray, penalty: np.ndarray, mix: float, start: np.ndarray) -> np.ndarray:
    """Coordinate descent for a stack of groups: slopes of standardised columns for one penalty per group.

    Each sweep sets one slope after the other to its best value; groups whose slopes no longer change leave.
    """
    slopes, size = start.copy(), start.shape[1]
    going = np.arange(len(slopes))
    for _ in range(MOST_SWEEPS):
        own, change = slopes[going], np.zeros(len(going))
        for j in range(size):
            rest = with_target[going, j] - np.einsum("gk,gk->g", correlation[going, j], own) + correlation[going, j, j] * own[:, j]
            shrunk = np.sign(rest) * np.maximum(np.abs(rest) - penalty[going] * mix, 0)
            scale = correlation[going, j, j] + penalty[going] * (1 - mix)
            best = np.where(correlation[going, j, j] > 0, shrunk / np.where(scale > 0, scale, 1), 0.0)
            change = np.maximum(change, np.abs(best - own[:, j]))
            own[:, j] = best
        slopes[going] = own
        going = going[change > TOLERANCE]
        if not len(going):
            break
    return slopes


def elastic_net_paths(df: DataFrame, keys: Sequence[str], columns: Sequence[str], target: str, penalties: Sequence[float],
                      mix: float = MIX) -> DataFrame:
    """(keys, penalty, n, intercept, coef) per group and penalty, the largest penalty first and each fit begun at the last.

    The objective is that of the library's single fit: half the mean squared error of columns and target
    brought to standard deviation 1 (of the population), plus ``penalty`` over the target's deviation times
    ``mix`` of the absolute and half of ``1 - mix`` of the squared slopes. A constant column has slope 0, a
    constant target all. Rows with a null do not count; a group without others has no row.
    """
    ordered, size = sorted(penalties, reverse=True), len(columns)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            covariance = np.zeros((len(batch), size + 1, size + 1))
            for i, j in combinations_with_replacement(range(size + 1), 2):
                covariance[:, i, j] = covariance[:, j, i] = batch[f"cov_{i}_{j}"].to_numpy(dtype=float)
            means = batch[[f"mean_{i}" for i in range(size + 1)]].to_numpy(dtype=float)
            deviation = np.sqrt(np.maximum(np.einsum("gii->gi", covariance), 0))
            # what is left of a constant after rounding counts as nothing
            deviation = np.where(deviation > 1e-12 * np.abs(means), deviation, 0.0)
            unit = np.divide(1.0, deviation, out=np.zeros_like(deviation), where=deviation > 0)
            scaled = covariance * unit[:, :, None] * unit[:, None, :]
            slopes = np.zeros((len(batch), size))
            for penalty in ordered:
                slopes = descend(scaled[:, :size, :size], scaled[:, :size, size], penalty * unit[:, size], mix, slopes)
                coef = slopes * unit[:, :size] * deviation[:, size:]
                yield batch[list(keys)].assign(penalty=penalty, n=batch["n"], coef=list(coef),
                                               intercept=means[:, size] - (coef * means[:, :size]).sum(axis=1))

    stored = moments(df, keys, columns, target)
    types = "".join(f"`{key}` {df.schema[key].dataType.simpleString()}, " for key in keys)
    return stored.mapInPandas(solve, f"{types}penalty double, n long, coef array<double>, intercept double")


def optimality_gaps(df: DataFrame, paths: DataFrame, keys: Sequence[str], columns: Sequence[str], target: str,
                    mix: float = MIX) -> DataFrame:
    """(keys, penalty, gap): by how much the best slopes' conditions are missed, from the rows' residuals.

    A slope that is not 0 must have the residuals' correlation equal to its penalty's pull, one that is 0 at
    most the absolute part of it. All penalties of a group are tried in one pass over the rows.
    """
    complete = df.dropna(subset=[*columns, target])
    models = paths.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("penalty", "intercept", "coef"))).alias("path"))
    spreads = complete.groupBy(*keys).agg(*[F.stddev_pop(c).alias(f"sd_{i}") for i, c in enumerate([*columns, target])])
    rows = attach(complete.select(*keys, *columns, target), models, keys).select(
        *keys, *columns, target, F.inline("path"))
    fitted = F.col("intercept")
    for i, c in enumerate(columns):
        fitted = fitted + F.get("coef", i) * F.col(c)
    residual = F.col(target) - fitted
    sums = rows.groupBy(*keys, "penalty").agg(F.first("coef").alias("coef"), *[
        F.covar_pop(F.col(c), residual).alias(f"pull_{i}") for i, c in enumerate(columns)], F.avg(residual).alias("bias"))
    joined = attach(sums, spreads, keys)
    target_sd = F.col(f"sd_{len(columns)}")
    gaps: list[Column] = [F.abs("bias")]
    for i in range(len(columns)):
        pull = F.col(f"pull_{i}") / (F.col(f"sd_{i}") * target_sd)
        slope = F.get("coef", i) * F.col(f"sd_{i}") / target_sd
        weight = F.col("penalty") / target_sd
        inside = F.greatest(F.abs(pull) - weight * mix, F.lit(0.0))
        exact = F.abs(pull - weight * (mix * F.signum(slope) + (1 - mix) * slope))
        gaps.append(F.coalesce(F.when(slope == 0, inside).otherwise(exact), F.lit(0.0)))
    return joined.select(*keys, "penalty", F.greatest(*gaps).alias("gap"))
