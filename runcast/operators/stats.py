"""Vector summaries, correlation, run means and the variance filter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VARIANCE_FLOOR = 0.16


def vector_summary(df: DataFrame, features: str = "features", weight: str | None = None) -> DataFrame:
    """Mean per dimension and count, in long form ``(i, mean, count)``; optionally weighted."""
    summary = Summarizer.metrics("mean", "count")
    column = summary.summary(F.col(features), F.col(weight)) if weight else summary.summary(F.col(features))
    one = df.select(column.alias("s")).select(vector_to_array("s.mean").alias("mean"), F.col("s.count").alias("count"))
    return one.select(F.posexplode("mean").alias("i", "mean"), "count")


def vector_mean(df: DataFrame, features: str = "features", weight: str | None = None) -> DataFrame:
    """Mean per dimension ``(i, mean)``; optionally weighted."""
    column = Summarizer.mean(F.col(features), F.col(weight)) if weight else Summarizer.mean(F.col(features))
    return df.select(F.posexplode(vector_to_array(column)).alias("i", "mean"))


def correlation_matrix(df: DataFrame, features: str = "features") -> DataFrame:
    """Pearson correlation of a vector column in long form ``(i, j, value)``."""
    matrix = Correlation.corr(df, features).first()[0]
    cells = [(i, j, float(matrix[i, j])) for i in range(matrix.numRows) for j in range(matrix.numCols)]
    return df.sparkSession.createDataFrame(cells, "i int, j int, value double")


def correlation_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The same over plain columns, without assembling vectors; one pass, no driver step."""
    cells = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"),
                      (F.lit(1.0) if i == j else F.corr(columns[min(i, j)], columns[max(i, j)])).alias("value"))
             for i in range(len(columns)) for j in range(len(columns))]
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def mean_times(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean time and number of repeats per configuration; rows without a time do not count."""
    return samples.where(F.col("time").isNotNull()).groupBy(*keys).agg(
        F.avg("time").alias("time"), F.count("time").alias("repeats"))


def target_correlations(df: DataFrame, keys: Sequence[str], columns: Sequence[str], target: str = "time") -> DataFrame:
    """Pearson correlation of each column with the target per group (null without variance)."""
    return df.groupBy(*keys).agg(*[F.corr(c, target).alias(c) for c in columns])


def variance_mask(df: DataFrame, keys: Sequence[str], columns: Sequence[str], floor: float = VARIANCE_FLOOR) -> DataFrame:
    """Per group and column, whether the population variance exceeds ``floor``."""
    return df.groupBy(*keys).agg(*[(F.var_pop(c) > F.lit(floor)).alias(c) for c in columns])
