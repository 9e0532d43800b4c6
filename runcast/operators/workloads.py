"""The machine-learning workloads whose run times are modelled, and their results as tables."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel, NaiveBayes, NaiveBayesModel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runcast.operators import prepare
from runcast.sources import mldata

# fixed settings of the workloads
CLUSTERS = 4
CLUSTER_SEED = 1
COMPONENTS = 3
MOST_ITERATIONS = 10
ELASTIC_MIX = 0.8
LINEAR_PENALTY = 0.3
CENTER_TOLERANCE = 1e-2


def _cells(df: DataFrame, matrix: np.ndarray, names: Sequence[str]) -> DataFrame:
    """A model's small matrix as rows ``(row, column, value)``."""
    cells = [(int(i), int(j), float(v)) for (i, j), v in np.ndenumerate(matrix)]
    return df.sparkSession.createDataFrame(cells, f"{names[0]} int, {names[1]} int, value double")


def kmeans_fit(df: DataFrame, clusters: int = CLUSTERS, seed: int = CLUSTER_SEED) -> KMeansModel:
    return KMeans().setK(clusters).setSeed(seed).fit(df)


def centers_table(df: DataFrame, centers: np.ndarray) -> DataFrame:
    """Centres as ``(cluster, dim, value)``."""
    return _cells(df, centers, ["cluster", "dim"])


def kmeans_centers(df: DataFrame, model: KMeansModel) -> DataFrame:
    return centers_table(df, np.array(model.clusterCenters()))


def kmeans_assign(df: DataFrame, model: KMeansModel) -> DataFrame:
    """Add ``prediction``, the nearest centre."""
    return model.transform(df)


def cluster_quality(assigned: DataFrame, prediction: str = "prediction") -> float:
    """Mean over rows of how much nearer the own cluster is than the next one, from -1 to 1 (squared distances)."""
    return ClusteringEvaluator(predictionCol=prediction).evaluate(assigned)


def nearest(features: Column, centers: np.ndarray) -> Column:
    """Number of the nearest of a few given centres; the lowest on ties."""

    @F.arrow_udf("int")
    def number(vectors: pa.Array) -> pa.Array:
        rows = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, centers.shape[1])
        distances = np.stack([((rows - center) ** 2).sum(1) for center in centers], axis=1)
        return pa.array(distances.argmin(1).astype(np.int32))

    return number(vector_to_array(features))


def assignment_cost(df: DataFrame, centers: np.ndarray) -> float:
    """Sum of squared distances to the nearest of the given centres."""

    @F.arrow_udf("double")
    def distance(vectors: pa.Array) -> pa.Array:
        rows = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, centers.shape[1])
        return pa.array(np.min([((rows - center) ** 2).sum(1) for center in centers], axis=0))

    return df.agg(F.sum(distance(vector_to_array("features")))).first()[0]


def lloyd_round(df: DataFrame, centers: np.ndarray) -> np.ndarray:
    """Centres after one round from the given ones; a centre nothing is near to stays."""
    sums = df.groupBy(nearest(F.col("features"), centers).alias("cluster")).agg(
        Summarizer.mean(F.col("features")).alias("mean"))
    moved = centers.copy()
    for row in sums.collect():  # one row per centre
        moved[row["cluster"]] = row["mean"].toArray()
    return moved


def lloyd(df: DataFrame, centers: np.ndarray, rounds: int) -> np.ndarray:
    """k-means from chosen starting centres."""
    for _ in range(rounds):
        centers = lloyd_round(df, centers)
    return centers


def linear_fit(df: DataFrame, penalty: float = LINEAR_PENALTY) -> LinearRegressionModel:
    """Elastic net regression."""
    return LinearRegression(maxIter=MOST_ITERATIONS, regParam=penalty, elasticNetParam=ELASTIC_MIX).fit(df)


def logistic_fit(df: DataFrame) -> LogisticRegressionModel:
    """Logistic regression; without a penalty the mix has no effect."""
    return LogisticRegression(maxIter=MOST_ITERATIONS, elasticNetParam=ELASTIC_MIX).fit(df)


def bayes_fit(df: DataFrame) -> NaiveBayesModel:
    """Multinomial naive Bayes over non-negative features and labels 0, 1, .."""
    return NaiveBayes().fit(df)


def linear_terms(df: DataFrame, model: LinearRegressionModel | LogisticRegressionModel) -> DataFrame:
    """``(term, value)``; term -1 is the intercept."""
    cells = [(-1, float(model.intercept)), *[(i, float(v)) for i, v in enumerate(model.coefficients.toArray())]]
    return df.sparkSession.createDataFrame(cells, "term int, value double")


def bayes_terms(df: DataFrame, model: NaiveBayesModel) -> DataFrame:
    """Log priors (feature -1) and log probabilities as ``(label, feature, value)``."""
    table = np.concatenate([model.pi.toArray()[:, None], model.theta.toArray()], axis=1)
    return _cells(df, table, ["label", "feature"]).withColumn("feature", F.col("feature") - 1)


def pca_fit(df: DataFrame, components: int = COMPONENTS) -> PCAModel:
    return PCA(k=components, inputCol="features", outputCol="projected").fit(df)


def _signs(model: PCAModel) -> np.ndarray:
    """+1 or -1 per component so that its largest entry by size is positive."""
    axes = model.pc.toArray()
    return np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])


def pca_axes(df: DataFrame, model: PCAModel) -> DataFrame:
    """Components as ``(dim, component, value)``."""
    return _cells(df, model.pc.toArray() * _signs(model), ["dim", "component"])


def pca_project(df: DataFrame, model: PCAModel) -> DataFrame:
    """Add ``projected`` as an array, signs fixed as in ``pca_axes``; rows are not centred."""
    projected = vector_to_array("projected")
    signed = [F.get(projected, i) * F.lit(float(s)) for i, s in enumerate(_signs(model))]
    return model.transform(df).withColumn("projected", F.array(*signed))


def timed(action: Callable[[], object]) -> tuple[object, float]:
    """The action's result and its wall seconds."""
    started = time.perf_counter()
    result = action()
    return result, time.perf_counter() - started


def without_negatives(df: DataFrame) -> DataFrame:
    """Features by their size, as counts must not be negative."""
    return df.withColumn("features", array_to_vector(F.transform(vector_to_array("features"), F.abs)))


@dataclass(frozen=True)
class Timed:
    """How a workload is timed: its action, whether its input is in memory first, and whether loading counts."""

    action: Callable[[DataFrame], object]
    cached: bool = True
    with_load: bool = False


# the clock limits of each workload: fits run on cached input, the two matrix workloads scan theirs while the clock
# runs, and the summary's time includes loading
TIMED = {
    "kmeans": Timed(kmeans_fit), "linear": Timed(linear_fit), "logistic": Timed(logistic_fit), "bayes": Timed(bayes_fit),
    "pca": Timed(pca_fit, cached=False), "correlation": Timed(lambda df: Correlation.corr(df, "features").first(), cached=False),
    "summary": Timed(lambda df: df.select(Summarizer.metrics("mean", "count").summary(F.col("features"))).first(),
                     cached=False, with_load=True),
}


def timed_run(load: Callable[[], DataFrame], workload: str, timed_as: Timed, fraction: float,
              seed: int = 17) -> tuple[str, int, int, float, float]:
    """One run sample ``(workload, cores, machine, fraction, time)`` within the workload's clock limits."""
    loading = time.perf_counter()
    rows = prepare.prepare(load(), fraction, seed=seed)
    if timed_as.cached:
        rows, _ = prepare.load_into_cache(rows)
    started = loading if timed_as.with_load else time.perf_counter()
    timed_as.action(rows)
    seconds = time.perf_counter() - started
    if timed_as.cached:
        rows.unpersist()
    return workload, rows.sparkSession.sparkContext.defaultParallelism, 1, fraction, seconds


def time_workloads(spark: SparkSession, path: str, fractions: Sequence[float],
                   workloads: Sequence[str] = tuple(TIMED)) -> DataFrame:
    """Run samples of the workloads over fractions of a libsvm folder (labels 0 and 1, features not negative)."""
    width = mldata.read_libsvm(spark, path).schema["features"].metadata["numFeatures"]
    samples = [timed_run(lambda: mldata.read_libsvm(spark, path, width), name, TIMED[name], fraction)
               for fraction in fractions for name in workloads]
    return spark.createDataFrame(samples, "workload string, cores int, machine int, fraction double, time double")
