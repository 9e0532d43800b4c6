"""How strongly each feature of a group goes with its time: an estimate of maximal information."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runcast.operators.keyed import attach
from runcast.session import materialize, spread

BINS = 64  # finest bins of either axis of the equal-frequency estimate
GRID_POWER = 0.6
# moved lines: at least so many places for lines on an axis, and this many times the wanted bins at most in one search
LEAST_LINES, LEAST_CLUMPS, CLUMPS_PER_BIN = 256, 32, 5
MOST_STEPS = 12  # halving steps that find a value among up to 2**12 lines
SMALL_GROUP = 4096  # rows up to which a group is scored from its rows
Pieces = Callable[[Column], Column]  # of a group's number of values


def ranked_values(df: DataFrame, keys: Sequence[str], columns: Sequence[str],
                  pieces: int | Pieces) -> DataFrame:
    """Upper edges of ``pieces`` equally filled bins per group and column: ``(feature, edges)``, exact at any size.

    ``pieces`` may depend on how many values the group has. The value at rank ``ceil(k n / pieces)`` for k = 1.. is found without
    gathering a group: distinct values are counted, range partitioned (which
    cuts a hot group by value), and only the partitions that hold a wanted
    rank are sorted and summed up.
    """
    spark = df.sparkSession
    group = [*keys, "feature"]
    entries = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    counts = df.select(*keys, F.inline(entries)).where(F.col("value").isNotNull()).groupBy(*group, "value").agg(
        F.count(F.lit(1)).alias("n"))
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = materialize(counts.repartitionByRange(parts, *group, "value").withColumn("part", F.spark_partition_id()),
                         "ranged-values")
    totals = ranged.groupBy(*group, "part").agg(F.sum("n").alias("held"))
    whole = Window.partitionBy(*group)  # one row per range partition
    placed = totals.withColumns({"before": F.sum("held").over(whole.orderBy("part")) - F.col("held"),
                                 "total": F.sum("held").over(whole)})
    many = F.lit(pieces) if isinstance(pieces, int) else pieces(F.col("total"))
    wanted = F.transform(F.sequence(F.lit(1), many - 1), lambda k: F.ceil(k * F.col("total") / many) - F.col("before"))
    wanted = F.filter(wanted, lambda rank: (rank > 0) & (rank <= F.col("held")))
    holding = placed.select(*group, "part", wanted.alias("ranks")).where(F.size("ranks") > 0)
    sums = Window.partitionBy(*group, "part").orderBy("value")
    summed = attach(ranged, holding, [*group, "part"]).withColumn("up_to", F.sum("n").over(sums))
    hits = F.filter("ranks", lambda rank: (rank > F.col("up_to") - F.col("n")) & (rank <= F.col("up_to")))
    found = summed.select(*group, "value", F.explode(hits))
    return found.groupBy(*group).agg(F.sort_array(F.collect_list("value")).alias("edges"))


def bin_edges(df: DataFrame, keys: Sequence[str], columns: Sequence[str], *, bins: int | Pieces = BINS) -> DataFrame:
    """The edges of ``bins`` equally filled bins per group in one row, as arrays ``edges_<column>``."""
    long = ranked_values(df, keys, columns, bins)
    return long.groupBy(*keys).agg(*[
        F.first(F.when(F.col("feature") == c, F.col("edges")), ignorenulls=True).alias(f"edges_{c}") for c in columns])


def _bin(column: str, bins: int | Pieces) -> Column:
    """How many edges lie below the value, by halving steps; null for a null value."""
    count = max(bins - 1, 1).bit_length() if isinstance(bins, int) else MOST_STEPS
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(count))])
    below = F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        F.coalesce(F.get(f"edges_{column}", at + step - 1) < F.col(column), F.lit(False)), at + step).otherwise(at))
    return F.when(F.col(column).isNotNull(), below)


def joint_histograms(df: DataFrame, keys: Sequence[str], columns: Sequence[str], target: str, *,
                     bins: int | Pieces = BINS) -> DataFrame:
    """Counts per group, column and pair of finest bins ``(feature, bin_x, bin_y, n)``.

    A row counts for a column if both the column and the target have a value. Rows are first counted per
    combination of all bins on their own partition, so that one row becomes several only after that.
    """
    edges = bin_edges(df, keys, [*columns, target], bins=bins)
    binned = attach(df.select(*keys, *columns, target), edges, keys)
    placed = [_bin(c, bins).alias(f"bin_{c}") for c in [*columns, target]]
    cells = binned.select(*keys, *placed).groupBy(*keys, *[f"bin_{c}" for c in [*columns, target]]).agg(
        F.count(F.lit(1)).alias("n"))
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"bin_{c}").alias("bin_x")) for c in columns])
    long = cells.select(*keys, F.inline(pairs), F.col(f"bin_{target}").alias("bin_y"), "n")
    return long.where("bin_x is not null and bin_y is not null").groupBy(*keys, "feature", "bin_x", "bin_y").agg(
        F.sum("n").alias("n"))


def best_grid_score(histogram: np.ndarray, power: float = GRID_POWER) -> float:
    """Largest normalised mutual information over all grids of at most ``n ** power`` cells (four at least).

    Coarse bin of a fine one: ``fine * bins // finest``. Cells of any grid are differences of one table of
    running sums.
    """
    finest, total = len(histogram), histogram.sum()
    sums = np.zeros((finest + 1, finest + 1))
    sums[1:, 1:] = histogram.cumsum(0).cumsum(1)
    cuts = {b: -(-np.arange(b + 1) * finest // b) for b in range(2, finest + 1)}
    entropy = lambda counts: -np.sum(counts * np.log(np.where(counts > 0, counts, 1.0) / total)) / total
    of_x = {b: entropy(np.diff(sums[cut, -1])) for b, cut in cuts.items()}
    of_y = {b: entropy(np.diff(sums[-1, cut])) for b, cut in cuts.items()}
    allowed, best = max(float(total) ** power, 4.0), 0.0
    for bx, cut in cuts.items():
        rows = np.diff(sums[cut], axis=0)
        for by in range(2, min(finest, int(allowed / bx)) + 1):
            both = entropy(np.diff(rows[:, cuts[by]], axis=1))
            best = max(best, (of_x[bx] + of_y[by] - both) / np.log(min(bx, by)))
    return best


def _score_cells(cells: DataFrame, keys: Sequence[str], score: Callable[[pa.Table], float]) -> DataFrame:
    """``score`` of the cells of each group and feature. A task holds one group's cells at a time."""
    kept = [*keys, "feature"]

    def scored(group: pa.Table) -> pa.Table:
        return group.slice(0, 1).select(kept).append_column("score", pa.array([score(group)], pa.float64()))

    types = ", ".join(f"`{c}` {cells.schema[c].dataType.simpleString()}" for c in kept)
    return spread(cells, *kept).groupBy(*kept).applyInArrow(scored, f"{types}, score double")


def information_scores(df: DataFrame, keys: Sequence[str], columns: Sequence[str], target: str, *,
                       bins: int = BINS) -> DataFrame:
    """Best normalised mutual information over grids ``(feature, score)`` per group.

    All grids of 2 to ``bins`` near equally filled bins on either axis with at most ``n ** 0.6`` cells are
    tried. Coarse bins are unions of fine ones, so all grids come from one histogram, which is a bounded
    row per group and feature (``bins`` squared at most) and is scored where it lies. An estimate from
    below: grid lines are not moved.
    """
    def score(cells: pa.Table) -> float:
        histogram = np.zeros((bins, bins))
        histogram[cells["bin_x"].to_numpy(), cells["bin_y"].to_numpy()] = cells["n"].to_numpy()
        return best_grid_score(histogram)

    return _score_cells(joint_histograms(df, keys, columns, target, bins=bins), keys, score)


# ---- grids whose lines move

def line_places(total: Column) -> Column:
    """Places for lines on an axis of a group with ``total`` values: every value up to LEAST_LINES of them."""
    return F.greatest(F.lit(LEAST_LINES), F.ceil(2 * F.pow(total.cast("double"), F.lit(0.3))).cast("int"))


def allowed_cells(total: int) -> int:
    """The most cells a grid may have: the largest whole number up to total ** 0.6, and four at least."""
    cells = max(int(round(total ** GRID_POWER)) + 1, 4)
    while cells > 4 and cells ** 5 > total ** 3:
        cells -= 1
    return cells


def _even_cuts(counts: np.ndarray, bins: int) -> np.ndarray:
    """Where ``bins`` near equally filled bins begin and the last one ends: an entry's bin is that of its middle rank."""
    middles = 2 * (np.cumsum(counts) - counts) + counts
    own = bins * middles // (2 * int(counts.sum()))
    return np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1, [len(counts)]])


def _lost(table: np.ndarray, segments: np.ndarray) -> np.ndarray:
    """Count times entropy of the rows (last axis) of each segment; ``table`` has x log x."""
    return table[segments.sum(axis=-1)] - table[segments].sum(axis=-1)


def _segment_losses(table: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """loss[s, t] of the entries s+1..t as one column, from running sums per row; infinite where t < s."""
    loss = np.full((len(sums), len(sums)), np.inf)
    step = max(1, (1 << 20) // sums.size)
    for first in range(0, len(sums), step):
        starts = slice(first, min(first + step, len(sums)))
        loss[starts, first:] = _lost(table, np.maximum(sums[None, first:] - sums[starts, None], 0))
    loss[np.tril_indices(len(loss), -1)] = np.inf
    return loss


def _best_columns(table: np.ndarray, sums: np.ndarray, rows: int, most: int) -> float:
    """Best score of a grid with ``rows`` fixed rows and 2 to ``most`` columns whose lines move over ``sums``.

    Mutual information is what the rows' entropy loses by the columns, a sum over columns, so the best
    columns up to each entry follow from the best of one column less.
    """
    total, full = sums[-1].sum(), _lost(table, sums[-1])
    before, after = _lost(table, sums), _lost(table, sums[-1] - sums)
    best = (full - (before + after).min()) / total / np.log(2)
    if most > 2 and len(sums) > 3:
        loss, lost = _segment_losses(table, sums), before
        for columns in range(3, min(most, len(sums) - 1) + 1):
            lost = (lost[:, None] + loss).min(axis=0)
            best = max(best, (full - (lost + after).min()) / total / np.log(min(rows, columns)))
    return best


def _best_of_axis(histogram: np.ndarray, allowed: int) -> float:
    """Rows near equally filled, columns moved: the best over all numbers of both."""
    across, down = histogram.sum(axis=1), histogram.sum(axis=0)
    whole = np.zeros((len(across) + 1, len(down) + 1), dtype=np.int64)
    whole[1:, 1:] = histogram.cumsum(0).cumsum(1)
    counts = np.arange(int(across.sum()) + 1, dtype=np.float64)
    table = counts * np.log(np.maximum(counts, 1))
    best = 0.0
    for rows in range(2, allowed // 2 + 1):
        most = allowed // rows
        row_cuts, clumps = _even_cuts(down, rows), max(LEAST_CLUMPS, CLUMPS_PER_BIN * most)
        places = _even_cuts(across, clumps) if len(across) > clumps else np.arange(len(across) + 1)
        best = max(best, _best_columns(table, np.diff(whole[np.ix_(places, row_cuts)], axis=1), rows, most))
        if len(row_cuts) > len(down):  # every value has its row already
            break
    return best


def moved_grid_score(histogram: np.ndarray) -> float:
    """Largest normalised mutual information over grids in which the lines of one axis move, for either axis."""
    histogram = histogram[histogram.any(axis=1)][:, histogram.any(axis=0)]
    if min(histogram.shape, default=0) < 2:
        return 0.0
    allowed = allowed_cells(int(histogram.sum()))
    return max(_best_of_axis(histogram, allowed), _best_of_axis(histogram.T, allowed))


def _row_histogram(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Joint counts over the line places of both axes, from the rows of one group."""
    def places(values: np.ndarray) -> np.ndarray:
        ordered, n = np.sort(values), len(values)
        pieces = max(LEAST_LINES, int(np.ceil(2 * n ** 0.3)))
        edges = ordered[-(-np.arange(1, pieces) * n // pieces) - 1]
        return np.searchsorted(edges, values, side="left")

    held = ~(np.isnan(x) | np.isnan(y))
    histogram = np.zeros((0, 0), dtype=np.int64)
    if held.any():
        own, other = places(x[~np.isnan(x)])[held[~np.isnan(x)]], places(y[~np.isnan(y)])[held[~np.isnan(y)]]
        histogram = np.zeros((own.max() + 1, other.max() + 1), dtype=np.int64)
        np.add.at(histogram, (own, other), 1)
    return histogram


def maximal_information(df: DataFrame, keys: Sequence[str], columns: Sequence[str], target: str, *,
                        small_group: int = SMALL_GROUP) -> DataFrame:
    """Maximal information ``(feature, score)`` per group: grid lines of one axis move, the other's are near even.

    For every number of rows the target (then the column) is cut into near equally filled rows, and the best
    2, 3, .. columns come from a dynamic programme over the places where lines may stand, with at most
    ``n ** 0.6`` cells in all and no bound on either axis alone. Places are all distinct values in groups of up
    to LEAST_LINES values, else that many (growing as ``n ** 0.3``) near equally filled pieces. If they are more
    than CLUMPS_PER_BIN times the columns in question (and than LEAST_CLUMPS), that search has so many fewer
    places.

    Groups of up to ``small_group`` rows are gathered as they are; of larger ones only the joint counts of
    the places are, which are no more than the places squared. A task holds one group at a time. Both give the
    same scores. A column without
    two values scores 0; rows with a null on either side do not count; a group without any that count has no row
    for that column.
    """
    held = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in [*columns, target]])
    types = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys) + ", feature string, score double"

    def score_rows(group: pa.Table) -> pa.Table:
        own = {c: group[c].to_numpy() for c in {*columns, target}}
        histograms = {feature: _row_histogram(own[feature], own[target]) for feature in columns}
        scores = {feature: moved_grid_score(h) for feature, h in histograms.items() if h.size}
        told = group.select(list(keys)).take(pa.array([0] * len(scores), pa.int64()))
        return told.append_column("feature", pa.array(list(scores), pa.string())).append_column(
            "score", pa.array(list(scores.values()), pa.float64()))

    def score_cells(cells: pa.Table) -> float:
        x, y = (cells[c].to_numpy() for c in ("bin_x", "bin_y"))
        histogram = np.zeros((x.max() + 1, y.max() + 1), dtype=np.int64)
        histogram[x, y] = cells["n"].to_numpy()
        return moved_grid_score(histogram)

    def by_rows(rows: DataFrame) -> DataFrame:
        return spread(rows, *keys).groupBy(*keys).applyInArrow(score_rows, types)

    # only large groups are told apart: they are no more than the rows by small_group
    large = materialize(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_held")).where(
        F.col("rows_held") > small_group), "large-groups")
    if large.isEmpty():
        return by_rows(held)
    sized = attach(held, large, keys, stored=True)
    few, many = (sized.where(f"rows_held is {sign}").drop("rows_held") for sign in ("null", "not null"))
    return by_rows(few).union(_score_cells(joint_histograms(many, keys, columns, target, bins=line_places), keys, score_cells))


def informative_features(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Features whose score reaches the mean score of their group."""
    mean = F.avg("score").over(Window.partitionBy(*keys))  # a handful of features per group
    return scores.withColumn("mean_score", mean).where(F.col("score") >= F.col("mean_score")).drop("mean_score")
