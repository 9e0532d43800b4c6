"""Joins and frontiers along an order, for keys of any size.

Rows are dealt over partitions by range of (keys, order), so a hot key spans many tasks in its order. Each
task works through its own rows in Arrow batches. All it can lack is what earlier tasks know of the one key
it begins with; each task therefore leaves two marker rows, for its first key and for the state its last key
ended in, and the states are passed on along each key afterwards, a few rows per task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from runcast.operators.keyed import attach
from runcast.session import materialize

_ROW, _FIRST, _LAST = 0, 1, 2


def _numbered(columns: Sequence[str], prefix: str) -> list[Column]:
    """The columns under names that clash with nothing."""
    return [F.col(c).alias(f"{prefix}{n}") for n, c in enumerate(columns)]


def _nullable(fields: Sequence[StructField]) -> StructType:
    """Marker rows leave out what only rows have."""
    return StructType([StructField(f.name, f.dataType) for f in fields])


class _Keys:
    """Where keys begin in the batches of one partition."""

    def __init__(self, names: Sequence[str]):
        self.names, self.first, self.last, self.begun = names, None, None, 0

    def starts(self, batch: pa.RecordBatch) -> np.ndarray:
        """True where a row's keys differ from those of the row before it."""
        fresh = np.zeros(batch.num_rows, dtype=bool)
        fresh[0] = self.last is None
        for name in self.names:
            column = batch.column(name)
            codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            fresh[1:] |= codes[1:] != codes[:-1]
            fresh[0] |= self.last is not None and column[0].as_py() != self.last.column(name)[0].as_py()
        self.first = self.first or batch.slice(0, 1)
        self.last = batch.slice(batch.num_rows - 1, 1)
        return fresh

    def in_first(self, fresh: np.ndarray) -> np.ndarray:
        """True for rows of the partition's first key."""
        count = self.begun + np.cumsum(fresh)
        self.begun = int(count[-1])
        return count == 1

    def markers(self, state: pa.Array, blank: Callable[[str], pa.Array], schema: pa.Schema) -> pa.RecordBatch:
        """The two rows a partition leaves behind it."""
        def column(name: str) -> pa.Array:
            if name in self.names:
                return pa.concat_arrays([self.first.column(name), self.last.column(name)])
            if name == "kind":
                return pa.array([_FIRST, _LAST], pa.int32())
            if name == "part":
                return pa.array([TaskContext.get().partitionId()] * 2, pa.int32())
            if name == "state":
                return pa.concat_arrays([pa.nulls(1, state.type), state])
            return blank(name)

        return pa.record_batch([column(name) for name in schema.names], schema=schema)


def _carried(told: DataFrame, names: Sequence[str], fold: Callable[[Column], Column]) -> DataFrame:
    """(keys, part, carry): for the first key of each part, the states earlier parts left, folded."""
    before = Window.partitionBy(*names).orderBy("part", "kind").rowsBetween(Window.unboundedPreceding, -1)
    marked = told.where(F.col("kind") != _ROW).select(*names, "part", "kind", "state")
    return marked.withColumn("carry", fold(F.col("state")).over(before)).where(
        (F.col("kind") == _FIRST) & F.col("carry").isNotNull()).select(*names, "part", "carry")


def as_of_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_on: str, right_on: str,
               columns: Sequence[str]) -> DataFrame:
    """``left`` with ``columns`` of the last ``right`` row of the same keys at or before its own place.

    Each left row stays, once, with nulls where no right row is early enough. Null keys equal null keys; a row
    whose place is null meets nothing. Of several right rows at one place the greatest by ``columns`` counts.
    Neither side is broadcast, and no key has to fit into a task.
    """
    names = [f"k{n}" for n in range(len(keys))]
    taken = F.struct(*_numbered(columns, "c"))
    kept = right.where(F.col(right_on).isNotNull()).select(*_numbered(keys, "k"), F.col(right_on).alias("at"),
                                                           F.lit(False).alias("asks"), taken.alias("state"))
    asked = left.select(*_numbered(keys, "k"), F.col(left_on).alias("at"), F.lit(True).alias("asks"),
                        F.struct(*_numbered(left.columns, "c")).alias("own"))
    order = [*names, "at", "asks", "state"]
    dealt = kept.unionByName(asked, allowMissingColumns=True).repartitionByRange(*order).sortWithinPartitions(*order)
    schema = _nullable([*[dealt.schema[n] for n in names], dealt.schema["own"], dealt.schema["state"],
                        StructField("part", IntegerType()), StructField("kind", IntegerType()),
                        StructField("settled", BooleanType())])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, shape, blanks = _Keys(names), None, None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            at, fresh, states = np.arange(batch.num_rows), known.starts(batch), batch.column("state")
            first = known.in_first(fresh)
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            begins = np.maximum.accumulate(np.where(fresh, at, -1))
            source = np.maximum.accumulate(np.where(asks, -1, at))
            source = np.where(source >= begins, source, -1)  # the last right row of the key in this batch
            if held is not None:  # or the one held, for the key that goes on from the batch before
                states = pa.concat_arrays([states, held])
                source = np.where((source < 0) & (begins < 0), len(at), source)
            columns_of = [*[batch.column(n) for n in names], batch.column("own"), states.take(pa.array(source, mask=source < 0)),
                          pa.array(np.full(len(at), TaskContext.get().partitionId(), dtype=np.int32)),
                          pa.array(np.full(len(at), _ROW, dtype=np.int32)), pa.array((source >= 0) | ~first)]
            out = pa.record_batch(columns_of, schema.names)
            shape, blanks = out.schema, {"own": pa.nulls(2, out.column("own").type), "settled": pa.nulls(2, pa.bool_())}
            held = states.slice(source[-1], 1) if source[-1] >= 0 else None
            yield out.filter(pa.array(asks))
        if shape is not None:
            state = held if held is not None else pa.nulls(1, shape.field("state").type)
            yield known.markers(state, blanks.__getitem__, shape)

    told = materialize(dealt.mapInArrow(fill, schema), "as-of")
    carried = _carried(told, names, lambda state: F.last(state, ignorenulls=True))
    rows = told.where(F.col("kind") == _ROW)
    open_ = attach(rows.where("not settled"), carried, [*names, "part"])
    whole = rows.where("settled").select("own", "state").union(open_.select("own", "carry"))
    return whole.select(*[F.col(f"own.c{n}").alias(c) for n, c in enumerate(left.columns)],
                        *[F.col(f"state.c{n}").alias(c) for n, c in enumerate(columns)])


def _lower_rows(names: Sequence[str], schema: StructType, marks: bool):
    """Keeps the rows, in order, whose ``low`` is below that of all rows of the key before them."""
    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, least, shape = _Keys(names), np.inf, None
        for batch in batches:
            if not batch.num_rows:
                continue
            fresh, low = known.starts(batch), batch.column("low").to_numpy(zero_copy_only=False)
            known.in_first(fresh)
            segment = np.cumsum(fresh)
            before = pd.Series(low).groupby(segment).cummin().to_numpy()
            before = np.concatenate([[np.inf], before[:-1]])
            before[fresh] = np.inf
            before = np.where(segment == 0, np.minimum(before, least), before)
            least = min(before[-1], low[-1])
            out = batch
            if marks:
                out = pa.record_batch([*batch.columns, pa.array(low), pa.array(np.full(len(low), TaskContext.get().partitionId(),
                                       dtype=np.int32)), pa.array(np.full(len(low), _ROW, dtype=np.int32))], schema.names)
            shape = out.schema
            yield out.filter(pa.array(low < before))
        if marks and shape is not None:
            yield known.markers(pa.array([least]), lambda name: pa.nulls(2, shape.field(name).type), shape)

    return sweep


def frontier(options: DataFrame, keys: Sequence[str], first: str, second: str) -> DataFrame:
    """The rows that no other row of the same keys beats: at most as much of both columns, and less of one.

    Of rows equal in both, the least by all columns stays. Rows with a null in either column are left out. Every
    task keeps its own frontier before rows move; the rest are dealt along ``first``, where a row belongs to the
    frontier if its ``second`` is below that of all before it.
    """
    names = [f"k{n}" for n in range(len(keys))]
    rows = options.where(F.col(first).isNotNull() & F.col(second).isNotNull()).select(
        *_numbered(keys, "k"), F.col(first).cast("double").alias("along"), F.col(second).cast("double").alias("low"),
        F.struct(*_numbered(options.columns, "c")).alias("own"))
    order = [*names, "along", "low", "own"]
    local = rows.sortWithinPartitions(*order).mapInArrow(_lower_rows(names, rows.schema, False), rows.schema)
    schema = _nullable([*rows.schema.fields, StructField("state", rows.schema["low"].dataType),
                        StructField("part", IntegerType()), StructField("kind", IntegerType())])
    dealt = materialize(local, "local-frontiers").repartitionByRange(*order).sortWithinPartitions(*order)
    told = materialize(dealt.mapInArrow(_lower_rows(names, schema, True), schema), "frontier")
    carried = _carried(told, names, F.min)
    kept = attach(told.where(F.col("kind") == _ROW), carried, [*names, "part"])
    return kept.where("carry is null or low < carry").select(
        *[F.col(f"own.c{n}").alias(c) for n, c in enumerate(options.columns)])
