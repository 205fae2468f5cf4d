"""Every registered query against its SQL, on the smallest test data, and its plan."""

from __future__ import annotations

import pytest

import workload
from tests.check_oracles import connect, difference


# Nested loops, cross joins and Python in the data path.
NEVER = ("BroadcastNestedLoopJoin", "CartesianProduct", "EvalPython", "InPandas", "InArrow")


@pytest.fixture(scope="module")
def sql(small):
    return connect(small)


@pytest.mark.parametrize("name", list(workload.QUERIES))
def test_query(name, spark, small, sql):
    df = workload.QUERIES[name](spark, small)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for node in NEVER:
        assert node not in plan
    got = df.toPandas()
    if name in workload.ORACLES:
        assert difference(got, sql.execute(workload.ORACLES[name]).fetchdf()) is None
    else:
        assert len(got) > 0


def test_every_oracle_has_a_query():
    assert set(workload.ORACLES) <= set(workload.QUERIES)


def test_entry_is_lazy_and_typed(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["bucket", "avg_value", "min_value", "max_value"]
    assert df.count() > 0
