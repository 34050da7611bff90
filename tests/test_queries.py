"""Every named query against its SQL twin, on the smallest tables, and its plan."""

import pytest
from compare import compare, oracle_connection

import __spark_entry__ as e
from threadloom.plans import catalog

FOLDER = "/root/testdata/sf0.001"
# Window functions and joins of these run before the query's own frame is planned.
QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES


@pytest.fixture(scope="module")
def con():
    return oracle_connection(FOLDER)


@pytest.mark.parametrize("name", QUERIES)
def test_same_as_sql(spark, con, name):
    problem = compare(spark, con, name, QUERIES[name], ORACLES.get(name), FOLDER)
    assert problem in (None, "no rows"), problem


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


def test_entry_has_all_queries():
    assert set(QUERIES) <= set(e.queries())
    assert set(ORACLES) <= set(e.oracle_sql())


def test_entry(spark):
    assert e.entry(spark).count() > 0


PLANNED = [n for n in QUERIES if n[:2] in ("t1", "j1", "j2", "j3", "j4", "j5", "a1", "a4", "a6", "w1", "w2", "w3", "w9", "k1", "p1")]


@pytest.mark.parametrize("name", PLANNED)
def test_no_cross_join(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
