import math

import pytest

from runcast.functions import sqlfunctions


def test_functions_and_their_nulls(spark):
    assert sqlfunctions.register(spark) == sqlfunctions.register(spark)  # again and again
    row = spark.sql("""SELECT model_terms(4, 2, 0.5) AS m, design_terms(4, 2, 0.25) AS d, run_price(7200, 3, 1.5) AS c,
        predicted_time(array(1D, 2D, 3D, 4D, 5D, 6D), 4, 2, 0.5) AS t, predicted_time(NULL, 4, 2, 0.5) AS n""").first()
    assert row["m"] == [1, 0.125, 0.25, 2, math.log(2), 4] and row["d"] == [1, 0.0625, 0.125, 2, math.log(2), 4]
    assert (row["c"], row["n"]) == (9.0, None)
    assert row["t"] == pytest.approx(1 + 0.25 + 0.75 + 8 + 5 * math.log(2) + 24)


def test_functions_are_inlined(spark):
    sqlfunctions.register(spark)
    plan = spark.sql("SELECT run_price(id, id, 2) AS c FROM range(9)")._jdf.queryExecution().optimizedPlan().toString()
    assert "3600" in plan and "run_price(" not in plan
