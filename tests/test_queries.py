"""Every registered query against its SQL, the shape of its plan, and the driver contract."""

import oracle
import pytest

import __spark_entry__ as driver
from textloom.queries import QUERIES

# Queries whose last plan runs a state machine; a caller's function has run before, into parquet
# or scores words with a profile that has gone to the texts
IN_PYTHON = {"breaker_replay", "breaker_by_type", "langid", "langid_hold_out"}
# One value over a whole table, added up per task before
ONE_VALUE = {"ttl_snapshot"}


@pytest.fixture(scope="module")
def db(folder):
    return oracle.connect(folder)


def test_entry(spark):
    rows = driver.entry(spark)
    assert rows.columns == ["doc_id", "task_id", "target_language", "n", "h"]
    assert rows.count() > 0


def check_plan(name, df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert unwanted not in plan
    assert ("InArrow" in plan) == (name in IN_PYTHON)
    assert ("SinglePartition" in plan) == (name in ONE_VALUE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, db, name):
    query, sql = QUERIES[name]
    df = query(spark, folder)
    check_plan(name, df)
    ours = df.toPandas()
    assert len(ours) > 0
    assert oracle.compare(ours, db.sql(sql).df()) == ""


def test_driver_offers_all_queries():
    assert set(QUERIES) <= set(driver.queries())
    assert {n for n, (_, sql) in QUERIES.items() if sql} <= set(driver.oracle_sql())
