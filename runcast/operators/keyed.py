"""Joining a per-group table to many rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runcast.session import BROADCAST_BYTES, materialize, stored_bytes


def attach(rows: DataFrame, per_group: DataFrame, keys: Sequence[str], *, stored: bool = False,
           how: str = "left", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Add the columns of a table with one row per key to ``rows``; null keys match null keys.

    No row is lost: a row whose key has no entry gets nulls (``how="inner"`` leaves such rows out). The
    per-group table is written once (unless it is ``stored`` already), which gives its true size: planned
    from a grouped result alone, the join would shuffle all ``rows`` before adaptive execution could know
    that the other side is small. Up to ``broadcast_bytes`` it is broadcast and ``rows`` never move; beyond
    that the join is a shuffled one, in which adaptive execution splits hot keys.
    """
    table = per_group if stored else materialize(per_group, "per-group")
    own = {key: f"_{key}_of_group" for key in keys}
    renamed = table.select(*[F.col(c).alias(own.get(c, c)) for c in table.columns])
    small = stored_bytes(table) <= broadcast_bytes
    same = reduce(and_, [rows[key].eqNullSafe(renamed[own[key]]) for key in keys], F.lit(True))
    return rows.join(F.broadcast(renamed) if small else renamed.hint("merge"), same, how).drop(*own.values())
