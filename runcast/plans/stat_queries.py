"""Queries on summaries, correlation, association and variance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runcast.functions.features import MODEL_TERMS
from runcast.operators import association, stats, timemodel
from runcast.plans import sqltext, views
from runcast.plans.input_queries import line_vectors
from runcast.plans.registry import query

_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_DIGITS = [8, 3, 9, 9]


def _long(what: str, more: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT CAST({i} AS INTEGER) AS i, round({what.format(c=c)}, {digits}) AS mean{more} FROM lineitem"
        for i, (c, digits) in enumerate(zip(_COLUMNS, _DIGITS)))


def _rounded(long: DataFrame) -> DataFrame:
    """The mean of each dimension to its own number of digits."""
    return long.withColumn("mean", F.coalesce(*[F.when(F.col("i") == i, F.round("mean", digits))
                                                for i, digits in enumerate(_DIGITS)]))


@query("summary_mean_count", _long("avg({c})", ", count(*) AS count"))
def summary_mean_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.vector_summary(line_vectors(spark, sf_dir)))


@query("vector_mean", _long("avg({c})"))
def vector_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.vector_mean(line_vectors(spark, sf_dir)))


@query("weighted_mean", _long("sum(l_linenumber * {c}) / sum(l_linenumber)"))
def weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.vector_mean(line_vectors(spark, sf_dir), weight="label"))


@query("weighted_summary", _long("sum(l_linenumber * {c}) / sum(l_linenumber)", ", count(*) AS count"))
def weighted_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.vector_summary(line_vectors(spark, sf_dir), weight="label"))


_CORRELATIONS = " UNION ALL ".join(
    f"SELECT CAST({i} AS INTEGER) AS i, CAST({j} AS INTEGER) AS j, "
    + ("CAST(1 AS DOUBLE)" if i == j else f"round(corr({a}, {b}), 8)") + " AS value FROM lineitem HAVING count(*) > 0"
    for i, a in enumerate(_COLUMNS) for j, b in enumerate(_COLUMNS))


@query("pearson_matrix", _CORRELATIONS)
def pearson_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = stats.correlation_matrix(line_vectors(spark, sf_dir))
    return matrix.select("i", "j", F.round("value", 8).alias("value"))


@query("pearson_columns", _CORRELATIONS)
def pearson_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = stats.correlation_columns(views.table(spark, sf_dir, "lineitem"), _COLUMNS)
    return matrix.select("i", "j", F.round("value", 8).alias("value"))


_TERMS = MODEL_TERMS[1:]
_KEYS = ["workload", "instance_type"]
_FEATURES = f"WITH {sqltext.RUNS}, {sqltext.FEATURES}"


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timemodel.model_features(views.runs(spark, sf_dir), _KEYS)


@query("target_correlations", f"""{_FEATURES}
SELECT workload, instance_type, {', '.join(f'round(corr({z}, time), 8) AS {z}' for z in _TERMS)}
FROM features GROUP BY workload, instance_type""")
def target_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.target_correlations(_features(spark, sf_dir), _KEYS, _TERMS)
    return found.select(*_KEYS, *[F.round(z, 8).alias(z) for z in _TERMS])


@query("variance_filter", f"""{_FEATURES}
SELECT workload, instance_type, {', '.join(f'var_pop({z}) > 0.16 AS {z}' for z in _TERMS)}
FROM features GROUP BY workload, instance_type""")
def variance_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.variance_mask(_features(spark, sf_dir), _KEYS, _TERMS)


_BINS = association.BINS
_EDGES = ", ".join(
    f"quantile_disc({c}, [{', '.join(f'{k}/{_BINS}' for k in range(1, _BINS))}]) AS edges_{c}" for c in [*_TERMS, "time"])
_BINNED = " UNION ALL ".join(
    f"SELECT workload, instance_type, '{z}' AS feature, len(list_filter(edges_{z}, lambda e: e < {z})) AS bin_x, "
    f"len(list_filter(edges_time, lambda e: e < time)) AS bin_y FROM edged" for z in _TERMS)
_HISTOGRAM = f"""{_FEATURES}, edges AS (
  SELECT workload, instance_type, {_EDGES} FROM features GROUP BY workload, instance_type),
edged AS (SELECT * FROM features JOIN edges USING (workload, instance_type)),
binned AS ({_BINNED}),
cells AS MATERIALIZED (
  SELECT workload, instance_type, feature, bin_x, bin_y, count(*) AS n FROM binned GROUP BY ALL)"""
_SCORES = f"""{_HISTOGRAM}, sizes AS (
  SELECT workload, instance_type, feature, greatest(pow(sum(n), 0.6), 4) AS allowed, sum(n) AS total FROM cells GROUP BY ALL),
rows_of AS MATERIALIZED (
  SELECT workload, instance_type, feature, hx, bin_x * hx // {_BINS} AS cx, bin_y, sum(n) AS n
  FROM cells CROSS JOIN (SELECT unnest(range(2, {_BINS} + 1)) AS hx) a GROUP BY ALL),
grids AS (
  SELECT workload, instance_type, feature, hx, hy, cx, bin_y * hy // {_BINS} AS cy, sum(n) AS n, any_value(total) AS total
  FROM rows_of JOIN sizes USING (workload, instance_type, feature)
  JOIN (SELECT unnest(range(2, {_BINS} + 1)) AS hy) b ON hx * hy <= allowed GROUP BY ALL),
margins AS (
  SELECT *, sum(n) OVER (PARTITION BY workload, instance_type, feature, hx, hy, cx) AS nx,
         sum(n) OVER (PARTITION BY workload, instance_type, feature, hx, hy, cy) AS ny
  FROM grids),
information AS (
  SELECT workload, instance_type, feature, hx, hy, sum(n / total * ln(n * total / (nx * ny))) AS mutual
  FROM margins GROUP BY ALL),
scores AS (
  SELECT workload, instance_type, feature, max(mutual / ln(least(hx, hy))) AS score FROM information GROUP BY ALL)"""


@query("joint_histogram", f"{_HISTOGRAM} SELECT workload, instance_type, feature, bin_x, bin_y, n FROM cells")
def joint_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = association.joint_histograms(_features(spark, sf_dir), _KEYS, _TERMS, "time")
    return cells.withColumns({c: F.col(c).cast("bigint") for c in ("bin_x", "bin_y")})


@query("mutual_information", f"""{_SCORES} SELECT workload, instance_type, feature, round(score, 6) AS score
FROM scores""")
def mutual_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = association.information_scores(_features(spark, sf_dir), _KEYS, _TERMS, "time")
    return scores.select(*_KEYS, "feature", F.round("score", 6).alias("score"))


@query("informative_features", f"""{_SCORES}
SELECT workload, instance_type, feature FROM scores
JOIN (SELECT workload, instance_type, avg(score) AS mean_score FROM scores GROUP BY ALL) m
  USING (workload, instance_type)
WHERE score >= mean_score""")
def informative_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = association.information_scores(_features(spark, sf_dir), _KEYS, _TERMS, "time")
    return association.informative_features(scores, _KEYS).select(*_KEYS, "feature")


# experiments of some 64 runs each, by blocks of orders
_MOVED = ["z1", "z2", "fraction"]
_PLACES, _PER_BIN = association.LEAST_CLUMPS, association.CLUMPS_PER_BIN
_MAXIMAL = f"""{_FEATURES}, pairs AS (
  SELECT l_orderkey // 16 AS experiment, feature, x, time AS y FROM features
  UNPIVOT INCLUDE NULLS (x FOR feature IN ({', '.join(_MOVED)}))),
axes AS (
  SELECT experiment, feature, side, CASE WHEN side = 0 THEN x ELSE y END AS a, CASE WHEN side = 0 THEN y ELSE x END AS b
  FROM pairs CROSS JOIN (SELECT unnest([0, 1]) AS side)),
cells AS (SELECT experiment, feature, side, a, b, count(*) AS n FROM axes GROUP BY ALL),
totals AS (
  SELECT experiment, feature, side, total, list_max(list_filter(range(4, 4 + total), lambda c:
           c = 4 OR c::HUGEINT * c * c * c * c <= total::HUGEINT * total * total)) AS allowed, places, others
  FROM (SELECT experiment, feature, side, CAST(sum(n) AS BIGINT) AS total, count(DISTINCT a) AS places,
          count(DISTINCT b) AS others FROM cells GROUP BY ALL)
  WHERE places > 1 AND others > 1),
down AS (
  SELECT experiment, feature, side, b, n, sum(n) OVER (PARTITION BY experiment, feature, side ORDER BY b) - n AS before
  FROM (SELECT experiment, feature, side, b, sum(n) AS n FROM cells GROUP BY ALL)),
across AS (
  SELECT experiment, feature, side, a, n, sum(n) OVER (PARTITION BY experiment, feature, side ORDER BY a) - n AS before,
    row_number() OVER (PARTITION BY experiment, feature, side ORDER BY a) AS place
  FROM (SELECT experiment, feature, side, a, sum(n) AS n FROM cells GROUP BY ALL)),
shapes AS (
  SELECT *, allowed // nrows AS most, greatest({_PLACES}, {_PER_BIN} * (allowed // nrows)) AS clumps
  FROM (SELECT *, unnest(range(2, allowed // 2 + 1)) AS nrows FROM totals)),
gridded AS (
  SELECT s.experiment, s.feature, s.side, nrows, most, total,
    CASE WHEN places > clumps THEN CAST(clumps * (2 * x.before + x.n) // (2 * total) AS BIGINT) ELSE x.place END AS clump,
    CAST(nrows * (2 * d.before + d.n) // (2 * total) AS BIGINT) AS row_, sum(c.n) AS n
  FROM shapes s JOIN cells c USING (experiment, feature, side) JOIN down d USING (experiment, feature, side, b)
  JOIN across x USING (experiment, feature, side, a) GROUP BY ALL),
placed AS (
  SELECT *, dense_rank() OVER (PARTITION BY experiment, feature, side, nrows ORDER BY clump) AS place FROM gridded),
kinds AS (SELECT DISTINCT experiment, feature, side, nrows, most, row_ FROM placed),
spots AS (
  SELECT *, unnest(range(0, last + 1)) AS place
  FROM (SELECT experiment, feature, side, nrows, max(place) AS last FROM placed GROUP BY ALL)),
sums AS (
  SELECT s.experiment, s.feature, s.side, s.nrows, k.most, s.place, s.last, k.row_,
    sum(coalesce(p.n, 0)) OVER (PARTITION BY s.experiment, s.feature, s.side, s.nrows, k.row_ ORDER BY s.place) AS up_to
  FROM spots s JOIN kinds k USING (experiment, feature, side, nrows)
  LEFT JOIN placed p USING (experiment, feature, side, nrows, place, row_)),
costs AS MATERIALIZED (
  SELECT l.experiment, l.feature, l.side, l.nrows, l.most, l.last, l.place AS s, r.place AS t,
    CASE WHEN sum(r.up_to - l.up_to) > 0 THEN sum(r.up_to - l.up_to) * ln(sum(r.up_to - l.up_to)) ELSE 0 END
      - sum(CASE WHEN r.up_to > l.up_to THEN (r.up_to - l.up_to) * ln(r.up_to - l.up_to) ELSE 0 END) AS cost
  FROM sums l JOIN sums r ON l.experiment = r.experiment AND l.feature = r.feature AND l.side = r.side
    AND l.nrows = r.nrows AND l.row_ = r.row_ AND l.place < r.place
  GROUP BY ALL),
best AS (
  SELECT experiment, feature, side, nrows, most, last, t, 1 AS ncols, cost AS lost FROM costs WHERE s = 0
  UNION ALL
  SELECT b.experiment, b.feature, b.side, b.nrows, b.most, b.last, c.t, b.ncols + 1, min(b.lost + c.cost)
  FROM best b JOIN costs c ON b.experiment = c.experiment AND b.feature = c.feature AND b.side = c.side
    AND b.nrows = c.nrows AND c.s = b.t
  WHERE b.ncols < b.most GROUP BY ALL),
whole AS (
  SELECT experiment, feature, side, nrows, cost AS full_, total FROM costs
  JOIN totals USING (experiment, feature, side) WHERE s = 0 AND t = last),
found AS (
  SELECT experiment, feature, max((full_ - lost) / total / ln(least(nrows, ncols))) AS score
  FROM best JOIN whole USING (experiment, feature, side, nrows) WHERE t = last AND ncols > 1 GROUP BY ALL)
SELECT experiment, feature, round(coalesce(score, 0), 6) AS score
FROM (SELECT DISTINCT experiment, feature FROM pairs) LEFT JOIN found USING (experiment, feature)"""


def _experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = timemodel.model_features(views.runs(spark, sf_dir), ["l_orderkey", "fraction"])
    return features.withColumn("experiment", F.floor(F.col("l_orderkey") / 16))


@query("maximal_information", _MAXIMAL.replace("WITH ", "WITH RECURSIVE ", 1))
def maximal_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = association.maximal_information(_experiments(spark, sf_dir), ["experiment"], _MOVED, "time")
    return scores.select("experiment", "feature", (F.round("score", 6) + 0.0).alias("score"))


@query("mean_times", """SELECT CAST(2 * (1 + user_id % 16) AS INTEGER) AS cores, event_type AS script,
       count(*) AS repeats, round(avg(value), 6) AS time
FROM events GROUP BY ALL""")
def mean_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = views.table(spark, sf_dir, "events").select(
        (2 * (1 + F.col("user_id") % 16)).cast("int").alias("cores"), F.col("event_type").alias("script"),
        F.col("value").alias("time"))
    return stats.mean_times(samples, ["cores", "script"]).withColumn("time", F.round("time", 6))
