"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as contract
import check
from runcast.plans import catalog

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
# a shuffle-free product of two tables never belongs in a plan of ours
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")


@pytest.fixture(scope="module")
def tables():
    return check.connect(SF_DIR)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, tables, name):
    result = contract.queries()[name](spark, SF_DIR)
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in FORBIDDEN)
    rows = result.toPandas()
    assert len(rows) > 0
    sql = contract.oracle_sql().get(name)
    if sql is not None:
        assert check.compare(rows, tables.sql(sql).df()) == ""


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert len(rows) == 9 * 40
    assert all(row["time"] > 0 for row in rows)


def test_every_oracle_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
