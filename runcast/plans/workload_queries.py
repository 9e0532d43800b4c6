"""Queries on the machine-learning workloads; most have a closed form to check against."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runcast.functions.features import MODEL_TERMS
from runcast.operators import grouped_logistic, penalised, timemodel, workloads
from runcast.plans import sqltext, views
from runcast.plans.registry import query
from runcast.session import materialize, scratch_path
from runcast.sources import mldata

_START = 4
_ROUNDS = 3


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("label").cast("double").alias("label"),
        array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))


def _first_vectors(vectors: DataFrame) -> np.ndarray:
    """The vectors with ids 0..3, as starting centres."""
    rows = vectors.where(F.col("vec_id") < _START).orderBy("vec_id").collect()
    return np.array([row["features"].toArray() for row in rows])


def _fitted_clusters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Centres of one fit, and the vectors with their cluster."""
    vectors = _vectors(spark, sf_dir)
    model = workloads.kmeans_fit(vectors)
    return workloads.kmeans_centers(vectors, model), workloads.kmeans_assign(vectors, model)


@query("kmeans_centers", """SELECT CAST(cluster AS INTEGER) AS cluster, CAST(dim AS INTEGER) AS dim, TRUE AS is_mean
FROM (SELECT unnest(range(4)) AS cluster) c CROSS JOIN (
  SELECT unnest(range(len(any_value(embedding)))) AS dim FROM embeddings) d""")
def kmeans_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every coordinate of every centre, and whether it is the mean of the rows that are nearest to it."""
    centers, assigned = _fitted_clusters(spark, sf_dir)
    means = assigned.groupBy(F.col("prediction").alias("cluster")).agg(
        vector_to_array(Summarizer.mean(F.col("features"))).alias("mean"))
    means = means.select("cluster", F.posexplode("mean").alias("dim", "mean"))
    # the fit ends when centres move less than its tolerance, so they may still differ from the means by that much
    return centers.join(means, ["cluster", "dim"]).select(
        "cluster", "dim", (F.abs(F.col("value") - F.col("mean")) <= workloads.CENTER_TOLERANCE).alias("is_mean"))


@query("kmeans_sizes", """SELECT count(*) AS vectors, CAST(4 AS BIGINT) AS clusters, FALSE AS any_empty FROM embeddings""")
def kmeans_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _fitted_clusters(spark, sf_dir)[1].groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.sum("n").alias("vectors"), F.count(F.lit(1)).alias("clusters"),
                     (F.min("n") == 0).alias("any_empty"))


@query("kmeans_certificate", """SELECT count(*) AS n, 4 AS clusters, 0 AS misplaced, TRUE AS no_dearer_than_start
FROM embeddings""")
def kmeans_certificate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector sits with its nearest fitted centre, and the fit beats the first vectors as centres."""
    vectors = _vectors(spark, sf_dir)
    model = workloads.kmeans_fit(vectors)
    start = workloads.assignment_cost(vectors, _first_vectors(vectors))
    fitted = np.array(model.clusterCenters())
    assigned = workloads.kmeans_assign(vectors, model).withColumn("nearest", workloads.nearest(F.col("features"), fitted))
    misplaced = (F.col("prediction") != F.col("nearest")).cast("int")
    return assigned.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("prediction").cast("int").alias("clusters"),
                        F.sum(misplaced).cast("int").alias("misplaced"),
                        F.lit(model.summary.trainingCost <= start).alias("no_dearer_than_start"))


def _lloyd_sql(rounds: int) -> str:
    """Assignments a<r> to centres c<r>, and the centres that follow, as rows (cluster, dim, v)."""
    parts = [f"""WITH cells AS (
  SELECT vec_id, unnest(range(64)) AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
c0 AS (SELECT vec_id AS cluster, dim, v FROM cells WHERE vec_id < {_START})"""]
    for r in range(rounds):
        parts.append(f"""d{r} AS (
  SELECT vec_id, cluster, sum((cells.v - c{r}.v) * (cells.v - c{r}.v)) AS distance
  FROM cells JOIN c{r} USING (dim) GROUP BY vec_id, cluster)""")
        parts.append(f"""a{r} AS (
  SELECT vec_id, cluster FROM (
    SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) AS place FROM d{r}) t WHERE place = 1)""")
        parts.append(f"""c{r + 1} AS (
  SELECT cluster, dim, avg(v) AS v FROM cells JOIN a{r} USING (vec_id) GROUP BY cluster, dim)""")
    return ",\n".join(parts)


@query("lloyd_rounds", f"""{_lloyd_sql(_ROUNDS)}
SELECT CAST(cluster AS INTEGER) AS cluster, CAST(dim AS INTEGER) AS dim, round(v, 6) AS value FROM c{_ROUNDS}""")
def lloyd_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    centers = workloads.lloyd(vectors, _first_vectors(vectors), _ROUNDS)
    return workloads.centers_table(vectors, centers).withColumn("value", F.round("value", 6))


@query("nearest_center", f"""{_lloyd_sql(1)} SELECT vec_id, CAST(cluster AS INTEGER) AS cluster FROM a0""")
def nearest_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    return vectors.select("vec_id", workloads.nearest(F.col("features"), _first_vectors(vectors)).alias("cluster"))


@query("cluster_quality", """WITH cells AS (
  SELECT vec_id, label, unnest(range(64)) AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
norms AS (SELECT vec_id, label, sum(v * v) AS norm FROM cells GROUP BY vec_id, label),
clusters AS (SELECT label AS cluster, count(*) AS n, sum(norm) AS norms FROM norms GROUP BY label),
sums AS (SELECT label AS cluster, dim, sum(v) AS s FROM cells GROUP BY label, dim),
dots AS (SELECT vec_id, cluster, sum(v * s) AS dot FROM cells JOIN sums USING (dim) GROUP BY vec_id, cluster),
distances AS (
  SELECT vec_id, label, cluster, n, n * norm + norms - 2 * dot AS total
  FROM dots JOIN norms USING (vec_id) JOIN clusters USING (cluster)),
sides AS (
  SELECT vec_id, max(CASE WHEN label = cluster THEN n END) AS n,
         max(CASE WHEN label = cluster THEN total / nullif(n - 1, 0) END) AS own,
         min(CASE WHEN label <> cluster THEN total / n END) AS other
  FROM distances GROUP BY vec_id)
SELECT round(avg(CASE WHEN n = 1 THEN 0 ELSE (other - own) / greatest(other, own) END), 6) AS quality FROM sides""")
def cluster_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given labels taken as clusters."""
    value = workloads.cluster_quality(_vectors(spark, sf_dir), prediction="label")
    return spark.createDataFrame([(value,)], "quality double").select(F.round("quality", 6).alias("quality"))


def _time_by_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mldata.assemble(views.runs(spark, sf_dir).withColumn("label", F.col("time")), ["machine"], "label")


@query("elastic_net", f"""WITH {sqltext.RUNS}, moments AS (
  SELECT avg(machine) AS mx, avg(time) AS my, stddev_pop(machine) AS sx, stddev_pop(time) AS sy,
         corr(machine, time) AS rho FROM runs),
slopes AS (
  SELECT *, sign(rho) * greatest(abs(rho) - 0.3 / sy * 0.8, 0) / (1 + 0.3 / sy * (1 - 0.8)) * sy / sx AS slope
  FROM moments)
SELECT CAST(-1 AS INTEGER) AS term, round(my - slope * mx, 5) AS value FROM slopes
UNION ALL SELECT CAST(0 AS INTEGER), round(slope, 5) FROM slopes""")
def elastic_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _time_by_machine(spark, sf_dir)
    return workloads.linear_terms(rows, workloads.linear_fit(rows)).withColumn("value", F.round("value", 5))


_GROUP = ["workload", "instance_type"]
_PENALTIES = [2.0, 0.6, 0.3, 0.05]


@query("elastic_net_by_group", f"""WITH {sqltext.RUNS}, moments AS (
  SELECT workload, instance_type, count(*) AS n, avg(machine) AS mx, avg(time) AS my, stddev_pop(machine) AS sx,
         stddev_pop(time) AS sy, corr(machine, time) AS rho FROM runs GROUP BY ALL),
slopes AS (
  SELECT *, sign(rho) * greatest(abs(rho) - penalty / sy * 0.8, 0) / (1 + penalty / sy * (1 - 0.8)) * sy / sx AS slope
  FROM moments CROSS JOIN (SELECT CAST(unnest({_PENALTIES}) AS DOUBLE) AS penalty) p)
SELECT workload, instance_type, penalty, n, round(my - slope * mx, 6) AS intercept, round(slope, 6) AS slope FROM slopes""")
def elastic_net_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With one column each group's path has a closed form."""
    paths = penalised.elastic_net_paths(views.runs(spark, sf_dir), _GROUP, ["machine"], "time", _PENALTIES)
    return paths.select(*_GROUP, "penalty", "n", F.round("intercept", 6).alias("intercept"),
                        F.round(F.get("coef", 0), 6).alias("slope"))


@query("elastic_net_path", f"""WITH {sqltext.RUNS}
SELECT workload, instance_type, CAST(unnest({_PENALTIES}) AS DOUBLE) AS penalty, TRUE AS optimal
FROM (SELECT DISTINCT workload, instance_type FROM runs) g""")
def elastic_net_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths over all terms of the time model; the conditions of an optimum are tried on the rows themselves."""
    features = timemodel.model_features(views.runs(spark, sf_dir), _GROUP)
    paths = penalised.elastic_net_paths(features, _GROUP, MODEL_TERMS[1:], "time", _PENALTIES)
    gaps = penalised.optimality_gaps(features, paths, _GROUP, MODEL_TERMS[1:], "time")
    return gaps.select(*_GROUP, "penalty", (F.col("gap") < 1e-7).alias("optimal"))


@query("logistic_odds", """WITH rates AS (
  SELECT avg(CASE WHEN l_quantity > 25 THEN y END) AS p1, avg(CASE WHEN l_quantity <= 25 THEN y END) AS p0
  FROM (SELECT l_quantity, CASE WHEN l_extendedprice > 40000 THEN CAST(1 AS DOUBLE) ELSE 0 END AS y FROM lineitem) t)
SELECT CAST(-1 AS INTEGER) AS term, round(ln(p0 / (1 - p0)), 3) AS value FROM rates
UNION ALL SELECT CAST(0 AS INTEGER), round(ln(p1 / (1 - p1)) - ln(p0 / (1 - p0)), 3) FROM rates""")
def logistic_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With one yes/no feature the fit must give the log odds."""
    lines = views.table(spark, sf_dir, "lineitem").select(
        (F.col("l_extendedprice") > 40000).cast("double").alias("label"),
        (F.col("l_quantity") > 25).cast("double").alias("x"))
    rows = mldata.assemble(lines, ["x"], "label")
    return workloads.linear_terms(rows, workloads.logistic_fit(rows)).withColumn("value", F.round("value", 3))


_LETTERS = ["e", "a", "n", "1"]


def _letter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    counts = [(F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))).cast("double").alias(f"n{i}")
              for i, c in enumerate(_LETTERS)]
    documents = views.table(spark, sf_dir, "documents").select("doc_id", *counts)
    labels = views.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("label"))
    return mldata.assemble(documents.join(labels, "doc_id"), [f"n{i}" for i in range(len(_LETTERS))], "label")


_SUMS_SQL = ", ".join(f"sum(length(text) - length(replace(text, '{c}', ''))) AS n{i}" for i, c in enumerate(_LETTERS))
_ALL_SQL = " + ".join(f"n{i}" for i in range(len(_LETTERS)))


@query("naive_bayes", f"""WITH classes AS (
  SELECT quality, count(*) AS n, {_SUMS_SQL} FROM documents JOIN labels USING (doc_id) GROUP BY quality),
total AS (SELECT sum(n) AS n, count(*) AS k FROM classes)
SELECT CAST(quality AS INTEGER) AS label, CAST(-1 AS INTEGER) AS feature,
       round(ln(classes.n + 1) - ln(total.n + k), 6) AS value FROM classes CROSS JOIN total
""" + "".join(f"""UNION ALL SELECT CAST(quality AS INTEGER), CAST({i} AS INTEGER),
       round(ln(n{i} + 1) - ln({_ALL_SQL} + {len(_LETTERS)}), 6) FROM classes
""" for i in range(len(_LETTERS))))
def naive_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _letter_counts(spark, sf_dir)
    return workloads.bayes_terms(rows, workloads.bayes_fit(rows)).withColumn("value", F.round("value", 6))


@query("document_logistic", """SELECT count(*) AS n, round(-(p * ln(p) + (1 - p) * ln(1 - p)), 6) AS constant_loss,
  TRUE AS no_worse_than_constant, TRUE AS balanced
FROM documents JOIN labels USING (doc_id) CROSS JOIN (
  SELECT avg(quality) AS p FROM documents JOIN labels USING (doc_id)) GROUP BY p""")
def document_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean loss of the fit against that of a constant, and whether its mean probability is the rate of ones."""
    rows = _letter_counts(spark, sf_dir)
    scored = workloads.logistic_fit(rows).transform(rows)
    p = F.get(vector_to_array("probability"), 1)
    rate = F.avg("label")
    loss = F.avg(-F.when(F.col("label") == 1, F.ln(p)).otherwise(F.ln(1 - p)))
    constant = -(rate * F.ln(rate) + (1 - rate) * F.ln(1 - rate))
    return scored.agg(F.count(F.lit(1)).alias("n"), F.round(constant, 6).alias("constant_loss"),
                      (loss <= constant).alias("no_worse_than_constant"),
                      (F.abs(F.avg(p) - rate) < 0.02).alias("balanced"))


_PCA_SQL = f"""WITH {sqltext.RUNS}, spread AS (
  SELECT var_samp(machine) AS a, covar_samp(machine, time) AS b, var_samp(time) AS c FROM runs),
axis AS (
  SELECT b / sqrt(b * b + (top - a) * (top - a)) AS p, (top - a) / sqrt(b * b + (top - a) * (top - a)) AS q
  FROM (SELECT *, (a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b) AS top FROM spread) t),
axes AS (
  SELECT p * s AS p1, q * s AS q1, -q * t AS p2, p * t AS q2
  FROM (SELECT *, CASE WHEN abs(p) > abs(q) THEN sign(p) ELSE sign(q) END AS s,
                  CASE WHEN abs(p) > abs(q) THEN sign(p) ELSE -sign(q) END AS t FROM axis) u)"""


def _pca_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mldata.assemble(views.runs(spark, sf_dir), ["machine", "time"], "l_orderkey", "l_linenumber")


@query("pca_axes", _PCA_SQL + "".join(
    f"{' UNION ALL' if k else ''} SELECT CAST({dim} AS INTEGER) AS dim, CAST({component} AS INTEGER) AS component, "
    f"round({name}, 7) AS value FROM axes" for k, (dim, component, name) in enumerate(
        [(0, 0, "p1"), (1, 0, "q1"), (0, 1, "p2"), (1, 1, "q2")])))
def pca_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pca_rows(spark, sf_dir)
    return workloads.pca_axes(rows, workloads.pca_fit(rows, 2)).withColumn("value", F.round("value", 7))


@query("pca_projection", f"""{_PCA_SQL}
SELECT l_orderkey, l_linenumber, round(machine * p1 + time * q1, 5) AS first, round(machine * p2 + time * q2, 5) AS second
FROM runs CROSS JOIN axes""")
def pca_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pca_rows(spark, sf_dir)
    projected = workloads.pca_project(rows, workloads.pca_fit(rows, 2))
    return projected.select("l_orderkey", "l_linenumber", *[
        F.round(F.get("projected", F.lit(i)), 5).alias(name) for i, name in enumerate(["first", "second"])])


_TIMED = list(workloads.TIMED)


@query("fit_timing", f"""SELECT workload, CAST(fraction AS DOUBLE) AS fraction, TRUE AS cores_known, CAST(1 AS INTEGER) AS machine,
  TRUE AS took_time
FROM (SELECT unnest([{', '.join(f"'{name}'" for name in _TIMED)}]) AS workload) w
CROSS JOIN (SELECT unnest([0.5, 1]) AS fraction) f WHERE (SELECT count(*) FROM embeddings) > 0""")
def fit_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run samples of our own: seconds of every workload on two fractions of a libsvm folder."""
    path = scratch_path(spark, "timed-input")
    zero_one = _vectors(spark, sf_dir).withColumn("label", (F.col("label") % 2).cast("double"))
    mldata.write_libsvm(workloads.without_negatives(zero_one), path)
    samples = workloads.time_workloads(spark, path, [0.5, 1.0])
    return samples.select("workload", "fraction", (F.col("cores") == spark.sparkContext.defaultParallelism).alias("cores_known"),
                          "machine", (F.col("time") > 0).alias("took_time"))


def _priced_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a line is expensive, for every return flag and line number; the flag N is unknown here."""
    return views.table(spark, sf_dir, "lineitem").select(
        F.nullif("l_returnflag", F.lit("N")).alias("flag"), F.col("l_linenumber").alias("line"),
        (F.col("l_extendedprice") > 40000).cast("double").alias("dear"), (F.col("l_quantity") > 25).cast("double").alias("many"),
        "l_quantity", "l_discount", "l_tax")


@query("logistic_by_group", """WITH rates AS (
  SELECT nullif(l_returnflag, 'N') AS flag, l_linenumber AS line, count(*) AS n, avg(CASE WHEN l_quantity > 25 THEN y END) AS p1,
         avg(CASE WHEN l_quantity <= 25 THEN y END) AS p0
  FROM (SELECT *, CASE WHEN l_extendedprice > 40000 THEN CAST(1 AS DOUBLE) ELSE 0 END AS y FROM lineitem) t GROUP BY ALL)
SELECT flag, line, n, round(ln(p0 / (1 - p0)), 5) AS intercept, round(ln(p1 / (1 - p1)) - ln(p0 / (1 - p0)), 5) AS slope
FROM rates WHERE p0 > 0 AND p0 < 1 AND p1 > 0 AND p1 < 1""")
def logistic_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With one yes/no column each group's fit must give the log odds; a group without them has no finite fit."""
    fits = grouped_logistic.logistic_fits(_priced_lines(spark, sf_dir), ["flag", "line"], ["many"], "dear")
    return fits.where("converged").select("flag", "line", "n", F.round("intercept", 5).alias("intercept"),
                                          F.round(F.get("coef", 0), 5).alias("slope"))


@query("logistic_optimality", """SELECT nullif(l_returnflag, 'N') AS flag, count(*) AS n, TRUE AS optimal
FROM lineitem GROUP BY ALL""")
def logistic_optimality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fits of several columns, whose gradient on the rows themselves is nothing."""
    lines, columns = _priced_lines(spark, sf_dir), ["l_quantity", "l_discount", "l_tax"]
    fits = materialize(grouped_logistic.logistic_fits(lines, ["flag"], columns, "dear"), "logistic-fits")
    gaps = grouped_logistic.gradients(lines, fits, ["flag"], columns, "dear").withColumnRenamed("flag", "own")
    both = fits.join(gaps, fits["flag"].eqNullSafe(gaps["own"]))
    return both.select("flag", "n", (F.col("gap") < 1e-9).alias("optimal"))
