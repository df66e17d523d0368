"""Every query with a SQL twin, at the smallest scale, and the shape of the plans."""

import pytest

import __spark_entry__ as entry
from check import connect, difference

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()
# Queries that act while they are built (staged rounds, files, fitted models).
EAGER = ("a", "k", "i8_", "i20", "i21", "i22", "j4", "j5", "j6", "f5", "h7", "h8", "h9", "g4", "e28", "e29",
         "op", "pipeline")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    problem = difference(QUERIES[name](spark, FOLDER).toPandas(), duck.execute(SQL[name]).df())
    assert problem is None, problem


@pytest.mark.parametrize("name", sorted(name for name in QUERIES if not name.startswith(EAGER)))
def test_plan_has_no_cross_join_and_no_python(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
                     "MapInPandas", "FlatMapGroups"):
        assert operator not in plan, operator


def test_names_agree():
    assert set(SQL) <= set(QUERIES)


def test_flagship(spark):
    assert set(entry.entry(spark).columns) == {"user1", "user2", "num_coocs", "unique_coocs", "two_unique", "diversity"}
