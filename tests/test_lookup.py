import pytest
from pyspark.sql import functions as F

from textloom.operators.lookup import (
    BROADCAST_ROWS,
    fits_broadcast,
    hot_keys,
    lookup_join,
    reference_table,
)


@pytest.fixture(scope="module")
def facts(spark):
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 11 == 0, None).otherwise(
        F.col("id") % 40
    )
    return spark.range(900).select("id", key.cast("int").alias("k")).cache()


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(30).select(F.col("id").cast("int").alias("k"), (F.col("id") * 2).alias("v"))


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_all_ways_give_the_same_rows(facts, table, how):
    plain = facts.join(table, ["k"], how)
    for limits in ({}, {"max_rows": 3}, {"max_rows": 3, "hot_rows": 100}):
        got = lookup_join(facts, table, ["k"], how, **limits)
        assert sorted(got.columns) == sorted(plain.columns)
        columns = sorted(plain.columns)
        both = [
            sorted((tuple(r) for r in d.select(*columns).collect()), key=repr) for d in (got, plain)
        ]
        assert both[0] == both[1]


def test_hot_keys(facts):
    assert [r.k for r in hot_keys(facts, ["k"], 250).collect()] == [7]
    assert hot_keys(facts, ["k"], 900) is None


def test_size_check(spark):
    assert fits_broadcast(spark.range(10))
    assert not fits_broadcast(spark.range(BROADCAST_ROWS + 1))
    wide = spark.range(10).select(F.repeat(F.lit("x"), 1000).alias("t"))
    assert not fits_broadcast(wide, max_bytes=5000)


def test_a_small_table_is_broadcast(facts, table):
    plan = lookup_join(facts, table, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_reference_table(spark):
    df = reference_table(spark, [("a", None), ("b", "x")], {"k": "string", "v": "string"})
    assert [tuple(r) for r in df.collect()] == [("a", None), ("b", "x")]
    assert reference_table(spark, [], {"k": "string"}).count() == 0
    assert "LocalTableScan" in df._jdf.queryExecution().executedPlan().toString()
