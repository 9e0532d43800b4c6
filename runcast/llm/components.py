"""Connected components by alternating star contraction: joins and minima only, nothing gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runcast.session import materialize


def _with_least(pairs: DataFrame) -> DataFrame:
    """(u, v, m) with m the least of u and all its v; a hub costs one partial minimum per task."""
    least = pairs.groupBy("u").agg(F.min("v").alias("_m")).withColumnRenamed("u", "_u")
    return pairs.join(least, pairs["u"] == F.col("_u")).select("u", "v", F.least("u", "_m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
                        .alias("e")).select("e.u", "e.v")
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` have v < u. Every smaller neighbour, and u itself, hang on the least neighbour."""
    least = _with_least(edges)
    hung = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))
    return least.select(F.explode(hung).alias("e")).select("e.u", "e.v").where("u <> v")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in ``edges`` (columns ``a`` and ``b``); the component is its least node.

    Each round writes its edges and compares a checksum with the round before; about log(diameter)
    rounds are needed. Loops, repeated edges and edges with a null end are left out; no edges, no rows.
    """
    least, most = F.least("a", "b"), F.greatest("a", "b")
    stars = materialize(edges.where("a <> b").select(most.alias("u"), least.alias("v")).distinct(), "edges")
    seen = None
    while True:
        row = stars.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if row["n"] == 0 or (row["n"], row["x"]) == seen:
            break
        seen = (row["n"], row["x"])
        stars = materialize(_small_star(_large_star(stars).distinct()).distinct(), "edges")
    roots = stars.select(F.col("v").alias("u"), "v").distinct()
    return stars.select("u", "v").union(roots).select(F.col("u").alias("node"), F.col("v").alias("component"))
