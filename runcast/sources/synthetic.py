"""Input for the workloads: regression, classification and cluster data.

Every row is a function of (seed, id), made where its partition is; any frame
with a whole-number id column can drive it.
"""

from __future__ import annotations

import hashlib

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runcast.functions.draws import DRAWS_PER_DIGEST, digest, normal_array, stream_seeds, uniform

# fixed defaults of the generated data sets
ROWS = 1_000_000
FEATURES = 50
SEED = 37
REGRESSION_INFORMATIVE = 4
LARGEST_COEFFICIENT = 100.0
FLIPPED_LABELS = 0.01
CENTERS = 4
CENTER_BOX = 10.0


def row_ids(spark: SparkSession, rows: int = ROWS, partitions: int | None = None) -> DataFrame:
    """Ids 0..rows-1 spread over partitions."""
    return spark.range(0, rows, 1, partitions) if partitions else spark.range(rows)


def _noise(ids: DataFrame, seed: int, features: int) -> DataFrame:
    """Add ``normal``, an array of standard normal draws, for each id."""
    hashed = ids.select("id", digest(seed, F.col("id")).alias("h"))
    return hashed.select("id", normal_array(stream_seeds(F.col("h")), features).alias("normal"))


def constants(seed: int, name: str, count: int) -> list[float]:
    """Uniform draws that belong to the data set, not to a row; by the rule of ``draws.uniform``."""
    digests = [hashlib.md5(f"{seed}:{name}:{block}".encode()).hexdigest() for block in range(-(-count // DRAWS_PER_DIGEST))]
    words = [int(text[8 * place:8 * place + 8], 16) for text in digests for place in range(DRAWS_PER_DIGEST)]
    return [(word + 0.5) / 2 ** 32 for word in words[:count]]


def _array(values: list[float]) -> Column:
    return F.expr(f"array({', '.join(f'{value!r}D' for value in values)})")


def _shifted(shift: Column) -> Column:
    return F.zip_with("normal", shift, lambda value, by: value + by)


def _labelled(rows: DataFrame, label: Column, features: Column) -> DataFrame:
    return rows.select("id", label.cast("double").alias("label"), array_to_vector(features).alias("features"))


def regression(ids: DataFrame, features: int = FEATURES, informative: int = REGRESSION_INFORMATIVE,
               seed: int = SEED) -> DataFrame:
    """Normal features; the label is a linear combination of the first ``informative`` ones, without noise."""
    coefficients = [LARGEST_COEFFICIENT * share for share in constants(seed, "coefficient", informative)]
    label = F.expr(" + ".join(f"{value!r}D * get(normal, {i})" for i, value in enumerate(coefficients)))
    return _labelled(_noise(ids, seed, features), label, F.col("normal"))


def classification(ids: DataFrame, features: int = FEATURES, seed: int = SEED,
                   flipped: float = FLIPPED_LABELS) -> DataFrame:
    """Two classes of two clusters on the corners of a square in the first two features, noise elsewhere.

    A small share of labels is drawn at random.
    """
    drawn = digest(seed, F.concat(F.lit("label:"), F.col("id").cast("string")))
    rows = _noise(ids, seed, features).withColumn("drawn", drawn)
    cluster = F.pmod("id", F.lit(4))
    corner = F.array(F.when(cluster < 2, F.lit(-1.0)).otherwise(F.lit(1.0)),
                     F.when(cluster % 2 == 0, F.lit(-1.0)).otherwise(F.lit(1.0)))
    shift = F.concat(corner, F.array_repeat(F.lit(0.0), features - 2))
    # opposite corners share a class
    own = F.when((cluster == 0) | (cluster == 3), F.lit(0.0)).otherwise(F.lit(1.0))
    random = F.when(uniform(F.col("drawn"), 1) < 0.5, F.lit(0.0)).otherwise(F.lit(1.0))
    label = F.when(uniform(F.col("drawn"), 0) < F.lit(flipped), random).otherwise(own)
    return _labelled(rows, label, _shifted(shift))


def blobs(ids: DataFrame, features: int = FEATURES, centers: int = CENTERS, seed: int = SEED,
          box: float = CENTER_BOX) -> DataFrame:
    """Unit normal clouds around centres drawn from a box; the label is the centre."""
    rows = _noise(ids, seed, features)
    cluster = F.pmod("id", F.lit(centers)).cast("int")
    places = F.array(*[_array([box * (2 * draw - 1) for draw in constants(seed, f"center {c}", features)])
                       for c in range(centers)])
    return _labelled(rows, cluster, _shifted(F.get(places, cluster)))
