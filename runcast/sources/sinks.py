"""Writers for features, averaged results and previews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runcast.functions.features import MODEL_TERMS


def write_features(selected: DataFrame, path: str, keys: Sequence[str] = ()) -> None:
    """``keys, time, 1.0, kept terms`` as CSV without header, quoted with ``|``.

    Files have one width: a term dropped for a group is 0 there.
    """
    columns = ["time", *MODEL_TERMS]
    selected.select(*keys, *[F.col(c).cast("double") for c in columns]).write.option("quote", "|").csv(path)


def write_run_texts(lines: DataFrame, path: str, order: Sequence[str] = (), compression: str = "none") -> None:
    """``(run, value)`` rows as text in folders ``run=<name>``.

    With an ``order`` each run is one file with its lines in that order. Without one a run that holds much of
    the lines is written by several tasks, as several files, and many small runs by one task.
    """
    if order:
        columns = ["run", *order]
        placed = lines.repartition("run").sortWithinPartitions(*columns)
    else:
        placed = lines.hint("rebalance", "run")
    placed.select("run", "value").write.partitionBy("run").option("compression", compression).text(path)


def append_results(means: DataFrame, path: str) -> None:
    """Append ``cores, fraction, mean time`` lines."""
    means.select("cores", "fraction", "time").write.mode("append").csv(path)


def preview(df: DataFrame, rows: int = 20) -> None:
    """Print the first rows in full width."""
    df.show(rows, truncate=False)
