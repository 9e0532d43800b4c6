import numpy as np
import pytest
from pyspark.sql import functions as F

from runcast.operators import choice, ordered


def as_of_by_hand(left, right):
    out = []
    for key, place, name in left:
        met = [(p, v) for k, p, v in right if k == key and p is not None and place is not None and p <= place]
        out.append((key, place, name, max(met)[1] if met else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batch", ["10000", "3"])
def test_as_of_against_brute_force(spark, batch):
    rng = np.random.default_rng(2)
    key = lambda: None if rng.random() < 0.1 else "hot" if rng.random() < 0.6 else f"k{rng.integers(0, 9)}"
    place = lambda: None if rng.random() < 0.05 else int(rng.integers(0, 300))
    left = [(key(), place(), n) for n in range(400)]
    right = [(key(), place(), int(n)) for n in range(60)]
    frames = (spark.createDataFrame(left, "k string, t long, name long").repartition(3),
              spark.createDataFrame(right, "g string, since long, v long").withColumnRenamed("g", "k"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = ordered.as_of_join(*frames, ["k"], "t", "since", ["v"])
        assert got.columns == ["k", "t", "name", "v"]
        assert sorted(map(tuple, got.collect()), key=repr) == as_of_by_hand(left, right)
        keyless = ordered.as_of_join(*frames, [], "t", "since", ["v"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    flat = as_of_by_hand([(0, t, n) for _, t, n in left], [(0, t, v) for _, t, v in right])
    assert sorted((row["t"], row["name"], row["v"]) for row in keyless if row["t"] is not None) == sorted(
        (t, n, v) for _, t, n, v in flat if t is not None)


def test_as_of_without_rows(spark):
    none = spark.createDataFrame([], "k int, t int, v int")
    some = spark.createDataFrame([(1, 2, 3)], "k int, t int, v int")
    assert ordered.as_of_join(none, some.withColumnRenamed("v", "w"), ["k"], "t", "t", ["w"]).count() == 0
    assert [tuple(r) for r in ordered.as_of_join(some, none.withColumnRenamed("v", "w"), ["k"], "t", "t", ["w"]).collect()] == [
        (1, 2, 3, None)]


@pytest.mark.parametrize("batch", ["10000", "2"])
def test_frontier_against_brute_force(spark, batch):
    rng = np.random.default_rng(6)
    rows = [(None if rng.random() < 0.1 else int(rng.integers(0, 2)), float(a), float(30 - a + rng.integers(0, 9)), n)
            for n, a in enumerate(rng.integers(0, 30, 300))]
    rows += [(0, None, 1.0, 900), (0, 1.0, None, 901), (5, 2.0, 2.0, 902), (5, 2.0, 2.0, 903)]
    frame = spark.createDataFrame(rows, "k int, time double, cost double, n int").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {tuple(r) for r in ordered.frontier(frame, ["k"], "time", "cost").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    whole = [r for r in rows if r[1] is not None and r[2] is not None]
    beaten = lambda r: any(o[0] == r[0] and o[1] <= r[1] and o[2] <= r[2] and (o[1:] < r[1:]) for o in whole)
    assert got == {r for r in whole if not beaten(r)}


def test_choices_for_many_limits(spark):
    options = spark.createDataFrame([("a", 1, 10.0, 5.0), ("a", 2, 6.0, 7.0), ("a", 3, 4.0, 20.0), ("a", 4, 5.0, 30.0), ("b", 1, 3.0, 1.0)],
                                    "w string, machine int, time double, cost double")
    limits = spark.createDataFrame([("a", 3.0), ("a", 4.0), ("a", 9.0), ("a", 99.0), ("b", 3.0), ("c", 3.0), ("a", None)],
                                   "w string, most double")
    got = {(r["w"], r["most"]): r["machine"] for r in choice.cheapest_for_deadlines(options, limits, ["w"], "most").collect()}
    assert got == {("a", 3.0): None, ("a", 4.0): 3, ("a", 9.0): 2, ("a", 99.0): 1, ("b", 3.0): 1, ("c", 3.0): None, ("a", None): None}
    got = {(r["w"], r["most"]): r["machine"] for r in choice.fastest_for_budgets(
        options, limits.withColumn("most", F.col("most") * 2), ["w"], "most").collect()}
    assert got == {("a", 6.0): 1, ("a", 8.0): 2, ("a", 18.0): 2, ("a", 198.0): 3, ("b", 6.0): 1, ("c", 6.0): None, ("a", None): None}
