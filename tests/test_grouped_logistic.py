import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from runcast.operators import grouped_logistic


def rows(spark, n=1200):
    part = lambda salt, size: F.pmod(F.hash("id", F.lit(salt)), F.lit(size)).cast("double")
    score = (part(1, 1000) - 500) / 100
    return spark.range(n).select(
        F.when(F.col("id") % 3 > 0, "hot").alias("g"), (100 + 7 * score).alias("x"), part(2, 10).alias("z"), F.lit(4.0).alias("c"),
        (score + (part(3, 1000) - 500) / 80 + (part(2, 10) - 5) / 4 > 0).cast("double").alias("y"))


def test_fits_against_the_library(spark):
    df = rows(spark)
    fits = {r["g"]: r for r in grouped_logistic.logistic_fits(df, ["g"], ["x", "z", "c"], "y").collect()}
    assert set(fits) == {"hot", None} and all(r["converged"] for r in fits.values())
    vectors = VectorAssembler(inputCols=["x", "z"], outputCol="features").transform(df)
    for g, row in fits.items():
        own = vectors.where(F.col("g").eqNullSafe(F.lit(g)))
        model = LogisticRegression(labelCol="y", maxIter=500, tol=1e-14).fit(own)
        np.testing.assert_allclose(row["coef"], [*model.coefficients.toArray(), 0.0], rtol=1e-4)
        np.testing.assert_allclose(row["intercept"], model.intercept, rtol=1e-4)
        assert row["n"] == own.count()
    again = grouped_logistic.logistic_fits(df, ["g"], ["x", "z", "c"], "y")
    assert grouped_logistic.gradients(df, again, ["g"], ["x", "z", "c"], "y").where("gap > 1e-9").count() == 0


def test_separated_labels_nulls_and_no_rows(spark):
    df = rows(spark, 200).withColumn("y", F.when(F.col("g").isNull(), (F.col("x") > 100).cast("double")).otherwise(F.col("y")))
    fits = {r["g"]: r for r in grouped_logistic.logistic_fits(df, ["g"], ["x"], "y", rounds=12).collect()}
    assert fits["hot"]["converged"] and not fits[None]["converged"] and fits[None]["coef"][0] > 1
    gapped = df.withColumn("x", F.when(F.col("z") > 3, F.col("x")))
    assert {r["g"]: r["n"] for r in grouped_logistic.logistic_fits(gapped, ["g"], ["x"], "y", rounds=2).collect()} == {
        r["g"]: r["count"] for r in gapped.where("x is not null").groupBy("g").count().collect()}
    assert grouped_logistic.logistic_fits(df.where("false"), ["g"], ["x"], "y").count() == 0
