"""Time models per group: moment sums, feature mask, non-negative fit, prediction, residuals.

Everything a fit needs is a sum, so one pass with map-side partial sums serves
any number of groups, hot ones included; Python sees one row per group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runcast.functions import solvers
from runcast.functions.features import MODEL_TERMS, terms
from runcast.operators.keyed import attach
from runcast.session import materialize

SIZE = len(MODEL_TERMS)
GRAM_COLUMNS = [f"g_{i}_{j}" for i, j in combinations_with_replacement(range(SIZE), 2)]
MOMENT_COLUMNS = [f"b_{i}" for i in range(SIZE)]
RATIO_COLUMNS = [f"r_{i}" for i in range(SIZE)]
PREDICTION_MACHINES = 40
MASK_SHARE = 0.1


def model_features(runs: DataFrame, keys: Sequence[str], kind: str = "model") -> DataFrame:
    """Keys, time and the six terms of every run."""
    columns = terms(kind, F.col("cores"), F.col("machine"), F.col("fraction"))
    return runs.select(*keys, F.col("time"), *[c.alias(name) for name, c in columns.items()])


def gram_sums(features: DataFrame, keys: Sequence[str]) -> DataFrame:
    """X'X (upper triangle), X'y, y'y and the mean of each term over time, per group."""
    # as text: a column object per product would cost more time than the plan
    grams = [f"sum(z{i} * z{j}) AS g_{i}_{j}" for i, j in combinations_with_replacement(range(SIZE), 2)]
    moments = [f"sum({z} * time) AS b_{i}" for i, z in enumerate(MODEL_TERMS)]
    ratios = [f"avg({z} / nullif(time, 0D)) AS r_{i}" for i, z in enumerate(MODEL_TERMS)]
    sums = ["count(1) AS n", *grams, *moments, "sum(time * time) AS yy", *ratios]
    return features.groupBy(*keys).agg(*[F.expr(s) for s in sums])


def _moments(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    gram = solvers.symmetric(batch[GRAM_COLUMNS].to_numpy(dtype=float), SIZE)
    return gram, batch[MOMENT_COLUMNS].to_numpy(dtype=float)


def _ols_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        solved = solvers.ordinary_least_squares(*_moments(batch))
        yield batch.assign(ols=list(solved))


def _nnls_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        allowed = np.array(batch["mask"].tolist(), dtype=bool).reshape(len(batch), SIZE)
        solved = solvers.nonnegative_least_squares(*_moments(batch), allowed)
        yield batch.assign(coef=list(solved))


def _with_array(df: DataFrame, name: str) -> str:
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]
    return ", ".join([*fields, f"`{name}` array<double>"])


def with_ols(grams: DataFrame) -> DataFrame:
    """Add ``ols``: intercept and five slopes of ordinary least squares."""
    return grams.mapInPandas(_ols_batches, _with_array(grams, "ols"))


def feature_mask(slopes: Column, share: float = MASK_SHARE) -> Column:
    """True where the absolute slope reaches ``share`` of the mean absolute slope."""
    sizes = F.transform(slopes, F.abs)
    floor = F.aggregate(sizes, F.lit(0.0), lambda total, size: total + size) / F.size(slopes) * F.lit(share)
    return F.transform(sizes, lambda size: size >= floor)


def with_mask(with_slopes: DataFrame, share: float = MASK_SHARE) -> DataFrame:
    """Add ``mask`` over the six terms; the intercept is always kept."""
    slopes = F.slice("ols", 2, SIZE - 1)
    return with_slopes.withColumn("mask", F.concat(F.array(F.lit(True)), feature_mask(slopes, share)))


def keep_all(grams: DataFrame) -> DataFrame:
    """A mask that drops nothing."""
    return grams.withColumn("mask", F.array(*[F.lit(True)] * SIZE))


def with_nnls(masked: DataFrame) -> DataFrame:
    """Add ``coef``: the non-negative fit on the kept terms, 0 for the dropped ones."""
    return masked.mapInPandas(_nnls_batches, _with_array(masked, "coef"))


def dot(array: str, columns: Sequence[str]) -> Column:
    """Sum of products of an array column's entries with columns."""
    return F.expr(" + ".join(f"get({array}, {place}) * {column}" for place, column in enumerate(columns)))


def training_error(models: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean signed error in percent, ``(mean(predicted / actual) - 1) * 100``.

    The mean of a linear prediction over time is the same combination of the
    mean ratios, which the moment pass already holds. Runs with time 0 do not count.
    """
    mean_ratio = dot("coef", RATIO_COLUMNS)
    return models.select(*keys, ((mean_ratio - 1.0) * 100.0).alias("error_pct"))


def fit_time_models(runs: DataFrame, keys: Sequence[str], *, kind: str = "model",
                    select_features: bool = True) -> DataFrame:
    """One model per group from one pass over the runs: n, mask, coef and training error."""
    grams = gram_sums(model_features(runs, keys, kind), keys)
    masked = with_mask(with_ols(grams)) if select_features else keep_all(grams)
    fitted = with_nnls(masked)
    mean_ratio = dot("coef", RATIO_COLUMNS)
    return fitted.select(*keys, "n", "mask", "coef", ((mean_ratio - 1.0) * 100.0).alias("error_pct"))


def selected_features(features: DataFrame, masks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the dropped terms of their group set to 0; the width stays fixed."""
    joined = attach(features, masks.select(*keys, "mask"), keys)
    kept = [F.when(F.get("mask", i), F.col(name)).otherwise(F.lit(0.0)).alias(name)
            for i, name in enumerate(MODEL_TERMS)]
    return joined.select(*keys, "time", *kept)


def score_runs(features: DataFrame, models: DataFrame, keys: Sequence[str], *, stored: bool = False) -> DataFrame:
    """Add ``predicted`` to every run; null where its group has no model. ``stored`` models are a written table."""
    joined = attach(features, models.select(*keys, "coef"), keys, stored=stored)
    predicted = dot("coef", MODEL_TERMS)
    return joined.withColumn("predicted", predicted).drop("coef")


def residual_norms(features: DataFrame, models: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Root of the squared residuals' sum, from a second pass (no cancellation)."""
    gap = F.col("time") - F.col("predicted")
    return score_runs(features, models, keys).groupBy(*keys).agg(F.sqrt(F.sum(gap * gap)).alias("rnorm"))


def predict_grid(models: DataFrame, keys: Sequence[str], *, machines: int = PREDICTION_MACHINES,
                 cores_per_machine: int = 2, fraction: float = 1.0, kind: str = "model") -> DataFrame:
    """Predicted time of every model on 1..``machines`` machines."""
    grid = models.select(*keys, "coef", F.explode(F.sequence(F.lit(1), F.lit(machines))).alias("machine"))
    grid = grid.withColumn("cores", F.col("machine") * cores_per_machine)
    grid = grid.withColumn("fraction", F.lit(float(fraction)))
    grid = grid.withColumns(terms(kind, F.col("cores"), F.col("machine"), F.col("fraction")))
    return grid.select(*keys, "machine", "cores", "fraction", dot("coef", MODEL_TERMS).alias("time"))


# ---- cross-validation

_SUMS = ["n", *GRAM_COLUMNS, *MOMENT_COLUMNS, "yy"]


def fold_models(features: DataFrame, keys: Sequence[str], fold: str = "fold") -> DataFrame:
    """Per group and fold the model of all other folds, beside the fold's own sums (columns ``own_...``).

    One pass over the rows gives the sums of every fold; what a model leaves out is subtracted from the sums of
    its group. ``left_n`` are the rows the model has learned from.
    """
    sums = gram_sums(features, [*keys, fold]).select(
        *keys, fold, *_SUMS, *[(F.col(r) * F.col("n")).alias(r) for r in RATIO_COLUMNS])
    whole = Window.partitionBy(*keys)  # one row per fold
    kept = [F.col(c).alias(f"own_{c}") for c in [*_SUMS, *RATIO_COLUMNS]]
    left = [(F.sum(c).over(whole) - F.col(c)).alias("left_n" if c == "n" else c) for c in _SUMS]
    return with_nnls(keep_all(sums.select(*keys, fold, *kept, *left)))


def cross_validation(features: DataFrame, keys: Sequence[str], fold: str = "fold") -> DataFrame:
    """Held-out errors per group: ``(folds, n, rmse, error_pct)``.

    Every run is predicted by the model that has not seen its fold; ``rmse`` is the root of the mean squared
    error and ``error_pct`` the mean signed error in percent (runs with time 0 break the latter: null). Both
    come from the folds' sums. A fold that is all of its group has no model and does not count; a group
    with one fold only has null errors.
    """
    products = []
    for i, j in combinations_with_replacement(range(SIZE), 2):
        twice = "" if i == j else "2 * "
        products.append(f"{twice}get(coef, {i}) * get(coef, {j}) * own_g_{i}_{j}")
    linear = " + ".join(f"get(coef, {i}) * own_b_{i}" for i in range(SIZE))
    ratio = " + ".join(f"get(coef, {i}) * own_r_{i}" for i in range(SIZE))
    told = fold_models(features, keys, fold).withColumns({
        "squares": F.expr(f"greatest(own_yy - 2 * ({linear}) + {' + '.join(products)}, 0D)"), "ratios": F.expr(ratio)})
    has_model = F.col("left_n") > 0
    n = F.sum(F.when(has_model, F.col("own_n")))
    return told.groupBy(*keys).agg(
        F.count(F.when(has_model, 1)).alias("folds"), F.coalesce(n, F.lit(0)).alias("n"),
        F.sqrt(F.sum(F.when(has_model, F.col("squares"))) / n).alias("rmse"),
        ((F.sum(F.when(has_model, F.col("ratios"))) / n - 1) * 100).alias("error_pct"))


# ---- models at every level

def level_sums(grams: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sums of every subset of the keys from those of the finest groups: keys, ``level``, sums.

    ``level`` is the grouping id: bit k from the right is 1 where the k-th key from the right is left out (and
    null). A null key of its own keeps its group.
    """
    return grams.cube(*keys).agg(F.grouping_id().cast("int").alias("level"), *[F.sum(c).alias(c) for c in _SUMS])


def shrunk_sums(levels: DataFrame, keys: Sequence[str], runs: float) -> DataFrame:
    """Adds to every group ``runs`` runs of its parent's average: the parent leaves out the last key still there.

    From the top down, so a parent has taken over from its own parent before. A group with many more runs than
    ``runs`` is left much as it is; one without enough to tell its terms apart borrows from above.
    """
    stored = materialize(levels, "levels")
    count = len(keys)
    depth_of = {level: count - level.bit_count() for level in range(1 << count)}
    last_key = {level: max((k for k in range(count) if not level >> (count - 1 - k) & 1), default=None) for level in depth_of}
    done = stored.where(F.col("level") == (1 << count) - 1).select(*keys, "level", F.col("n").cast("double").alias("weight"), *_SUMS)
    parts = [done]
    for depth in range(1, count + 1):
        children = [level for level in depth_of if depth_of[level] == depth]
        rows = stored.where(F.col("level").isin(children))
        at = {level: last_key[level] for level in children}
        up = F.coalesce(*[F.when(F.col("level") == level, F.lit(level | 1 << (count - 1 - k))) for level, k in at.items()])
        rows = rows.select("*", up.alias("up"), *[
            F.when(~F.col("level").isin([level for level, k in at.items() if k == place]), F.col(key)).alias(f"up_{key}")
            for place, key in enumerate(keys)])
        means = done.select(F.col("level").alias("up"), *[F.col(key).alias(f"up_{key}") for key in keys],
                            *[(F.col(c) / F.col("weight")).alias(f"mean_{c}") for c in _SUMS[1:]])
        joined = attach(rows, means, ["up", *[f"up_{key}" for key in keys]])
        done = joined.select(*keys, "level", (F.col("n") + runs).alias("weight"), "n",
                             *[(F.col(c) + runs * F.col(f"mean_{c}")).alias(c) for c in _SUMS[1:]])
        parts.append(done)
    return reduce(DataFrame.unionByName, parts)


def level_models(features: DataFrame, keys: Sequence[str], runs: float = 0.0) -> DataFrame:
    """(keys, level, n, coef) for every subset of the keys, shrunk towards the level above by ``runs`` runs."""
    levels = level_sums(gram_sums(features, keys), keys)
    sums = shrunk_sums(levels, keys, runs) if runs else levels
    return with_nnls(keep_all(sums)).select(*keys, "level", "n", "coef")
