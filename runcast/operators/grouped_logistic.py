"""Logistic regressions of many groups in shared Newton rounds."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runcast.operators.keyed import attach
from runcast.session import materialize

ROUNDS, TOLERANCE = 40, 1e-10
RIDGE = 1e-9  # of the mean curvature, so that a column that tells nothing takes no slope


def _scaled(df: DataFrame, keys: Sequence[str], columns: Sequence[str], label: str) -> DataFrame:
    """(keys, y, x0 = 1, x1.., mean_i, sd_i): columns with mean 0 and deviation 1 in each group; constants are 0."""
    complete = df.dropna(subset=[*columns, label])
    spreads = complete.groupBy(*keys).agg(*[F.avg(c).alias(f"mean_{i}") for i, c in enumerate(columns)],
                                          *[F.stddev_pop(c).alias(f"sd_{i}") for i, c in enumerate(columns)])
    rows = attach(complete, spreads, keys)
    unit = [F.when(F.col(f"sd_{i}") > F.lit(1e-12) * F.abs(f"mean_{i}"), (F.col(c) - F.col(f"mean_{i}")) / F.col(f"sd_{i}"))
            .otherwise(F.lit(0.0)).alias(f"x{i + 1}") for i, c in enumerate(columns)]
    return rows.select(*keys, F.col(label).cast("double").alias("y"), F.lit(1.0).alias("x0"), *unit,
                       *[f"mean_{i}" for i in range(len(columns))], *[f"sd_{i}" for i in range(len(columns))])


def _sums(rows: DataFrame, state: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """Loss, gradient and curvature of every group at its state, in one pass; partial sums leave the tasks."""
    score = " + ".join(f"get(coef, {i}) * x{i}" for i in range(size))
    near = attach(rows, state, keys, stored=True, how="inner").withColumn("score", F.expr(score))
    near = near.withColumn("p", F.expr("1 / (1 + exp(-score))"))
    # log(1 + e^s) without overflow
    loss = "sum(greatest(score, 0D) + log1p(exp(-abs(score))) - y * score) / count(1) AS loss"
    slopes = [f"sum((p - y) * x{i}) / count(1) AS g_{i}" for i in range(size)]
    curves = [f"sum(p * (1 - p) * x{i} * x{j}) / count(1) AS h_{i}_{j}" for i, j in combinations_with_replacement(range(size), 2)]
    return near.groupBy(*keys).agg(*[F.expr(e) for e in (
        "first(coef) AS coef", "first(before) AS before", "first(least) AS least", loss, *slopes, *curves, "count(1) AS n")])


def _step(size: int):
    """One Newton step per row; a step that has made the loss grow is halved instead."""
    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            coef, before = np.stack(batch["coef"]), np.stack(batch["before"])
            gradient = batch[[f"g_{i}" for i in range(size)]].to_numpy(dtype=float)
            curve = np.zeros((len(batch), size, size))
            for i, j in combinations_with_replacement(range(size), 2):
                curve[:, i, j] = curve[:, j, i] = batch[f"h_{i}_{j}"]
            ridge = RIDGE * np.maximum(np.einsum("gii->g", curve) / size, 1e-300)
            curve += ridge[:, None, None] * np.eye(size)
            newton = coef - np.linalg.solve(curve, gradient[:, :, None])[:, :, 0]
            grown = batch["loss"].to_numpy() > batch["least"].to_numpy() + 1e-15
            done = np.abs(gradient).max(axis=1) < TOLERANCE
            following = np.where(done[:, None], coef, np.where(grown[:, None], (coef + before) / 2, newton))
            out = batch.drop(columns=[c for c in batch.columns if c[:2] in ("g_", "h_")])
            yield out.assign(coef=list(following), before=list(np.where(grown[:, None], before, coef)),
                             least=np.where(grown, batch["least"], batch["loss"]), converged=done)

    return step


def logistic_fits(df: DataFrame, keys: Sequence[str], columns: Sequence[str], label: str, rounds: int = ROUNDS) -> DataFrame:
    """(keys, n, intercept, coef, loss, converged) per group, without penalty; ``label`` is 0 or 1.

    A round is one pass over the rows of all groups that still move: sums for the gradient and the curvature,
    map-side first, then a step on one row per group, written as the next state. Groups that have settled
    leave. Where a column separates the labels there is no finite fit; such a group ends after ``rounds``
    with ``converged`` false. A constant column has slope 0; rows with a null do not count; null keys are a key.
    """
    size = len(columns) + 1
    rows = materialize(_scaled(df, keys, columns, label), "logistic-rows")
    scales = [f"mean_{i}" for i in range(size - 1)] + [f"sd_{i}" for i in range(size - 1)]
    groups = materialize(rows.groupBy(*keys).agg(*[F.first(c).alias(c) for c in scales]), "logistic-scales")
    narrow = rows.drop(*scales)
    start = F.array_repeat(F.lit(0.0), size)
    state = materialize(groups.select(*keys, start.alias("coef"), start.alias("before"), F.lit(float("inf")).alias("least")), "state")
    settled = []
    types = "".join(f"`{key}` {df.schema[key].dataType.simpleString()}, " for key in keys)
    schema = types + "coef array<double>, before array<double>, least double, loss double, n long, converged boolean"
    names = [*keys, "coef", "loss", "n", "converged"]
    for turn in range(rounds):
        told = materialize(_sums(narrow, state, keys, size).mapInPandas(_step(size), schema), "state")
        last = turn == rounds - 1
        settled.append(told.where(F.lit(last) | F.col("converged")).select(*names))
        state = told.where("not converged").select(*keys, "coef", "before", "least")
        if last or state.isEmpty():
            break
    fits = settled[0]
    for part in settled[1:]:
        fits = fits.union(part)
    both = attach(fits, groups, keys)
    slopes = [F.when(F.col(f"sd_{i}") > F.lit(1e-12) * F.abs(f"mean_{i}"), F.get("coef", i + 1) / F.col(f"sd_{i}")).otherwise(0.0)
              for i in range(size - 1)]
    shift = sum((slopes[i] * F.col(f"mean_{i}") for i in range(size - 1)), F.lit(0.0))
    return both.select(*keys, "n", (F.get("coef", 0) - shift).alias("intercept"), F.array(*slopes).alias("coef"), "loss", "converged")


def gradients(df: DataFrame, fits: DataFrame, keys: Sequence[str], columns: Sequence[str], label: str) -> DataFrame:
    """(keys, gap): the largest mean of (p - y) times a column over its mean size, at the fits, from the rows."""
    rows = attach(df.dropna(subset=[*columns, label]), fits.select(*keys, "intercept", "coef"), keys)
    score = F.col("intercept")
    for i, c in enumerate(columns):
        score = score + F.get("coef", i) * F.col(c)
    off = 1 / (1 + F.exp(-score)) - F.col(label)
    parts = [F.abs(F.avg(off))] + [F.abs(F.avg(off * F.col(c))) / F.greatest(F.avg(F.abs(c)), F.lit(1e-300)) for c in columns]
    return rows.groupBy(*keys).agg(F.greatest(*parts).alias("gap"))
