import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from runcast.operators import penalised


def rows(spark, n=900):
    noise = F.pmod(F.hash("id"), F.lit(1000)) / 250
    x = (F.pmod(F.hash("id", F.lit(1)), F.lit(1000)) / 100).alias("x")
    return spark.range(n).select(F.when(F.col("id") % 3 > 0, "hot").alias("g"), x, "id", noise.alias("noise")).select(
        "g", "x", (F.col("x") * F.col("x") + F.col("noise")).alias("z"), (F.col("id") % 7).cast("double").alias("w"), F.lit(3.0).alias("c"),
        (5 + 2 * F.col("x") + F.when(F.col("g").isNull(), 4.0).otherwise(-1.0) * (F.col("id") % 7) + F.col("noise")).alias("time"))


@pytest.mark.parametrize("mix", [0.0, 0.8, 1.0])
def test_paths_against_the_library(spark, mix):
    df, columns, penalties = rows(spark), ["x", "z", "w"], [3.0, 0.5, 0.05, 0.0]
    paths = {(r["g"], r["penalty"]): r for r in penalised.elastic_net_paths(df, ["g"], columns, "time", penalties, mix).collect()}
    assert set(paths) == {(g, p) for g in ("hot", None) for p in penalties}
    vectors = VectorAssembler(inputCols=columns, outputCol="features").transform(df)
    for (g, penalty), row in paths.items():
        own = vectors.where(F.col("g").eqNullSafe(F.lit(g)))
        model = LinearRegression(labelCol="time", regParam=penalty, elasticNetParam=mix, maxIter=500, tol=1e-12).fit(own)
        # the library's deviations are those of a sample
        np.testing.assert_allclose(row["coef"], model.coefficients.toArray(), atol=0.01)
        assert row["n"] == own.count() and abs(row["intercept"] - model.intercept) < 0.05
    found = penalised.elastic_net_paths(df, ["g"], columns, "time", penalties, mix)
    assert penalised.optimality_gaps(df, found, ["g"], columns, "time", mix).where("gap > 1e-9").count() == 0


def test_slopes_come_in_as_the_penalty_falls(spark):
    path = penalised.elastic_net_paths(rows(spark), ["g"], ["x", "z", "w"], "time", [100.0, 4.0, 0.01]).where("g = 'hot'")
    kept = [sum(c != 0 for c in r["coef"]) for r in path.orderBy(F.desc("penalty")).collect()]
    assert kept[0] == 0 and kept == sorted(kept) and kept[-1] >= 2


def test_constants_nulls_and_no_rows(spark):
    df = rows(spark).withColumn("time", F.when(F.col("g").isNotNull(), F.col("time")).otherwise(7.0))
    df = df.withColumn("x", F.when(F.col("w") > 0, F.col("x")))
    got = {r["g"]: r for r in penalised.elastic_net_paths(df, ["g"], ["c", "x"], "time", [0.1]).collect()}
    assert got[None]["coef"] == [0.0, 0.0] and got[None]["intercept"] == 7.0
    assert got["hot"]["coef"][0] == 0.0 and got["hot"]["coef"][1] > 1
    assert got["hot"]["n"] == df.where("g = 'hot' and x is not null").count()
    assert penalised.elastic_net_paths(df.where("false"), ["g"], ["x"], "time", [0.1]).count() == 0
