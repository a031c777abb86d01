"""Groups cut into chunks give what a plain window gives."""

import pytest
from pyspark.sql import Window, functions as F

from textloom.operators.ordered import Ordered, in_chunks, pages, positions


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one group, one group with a null key, repeated order values."""
    rows = spark.range(3000).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, "hot")
        .when(F.col("id") % 50 == 1, None)
        .otherwise(F.concat(F.lit("k"), (F.col("id") % 97).cast("string")))
        .alias("key"),
        (F.xxhash64("id") % 40).alias("place"),
        F.when(F.col("id") % 7 > 2, F.col("id") * 3).alias("amount"),
    )
    return rows.repartition(7).cache()


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def expected(df, keys):
    w = Window.partitionBy(*keys).orderBy("place", "id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    wanted = F.when(F.col("id") % 5 == 0, F.struct("id"))
    return df.select(
        "id",
        F.row_number().over(w).alias("position"),
        F.coalesce(F.last(wanted, True).over(before)["id"], F.lit(-1)).alias("before"),
        F.coalesce(
            F.sum("amount").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(-1)
        ).alias("total"),
    )


@pytest.mark.parametrize("chunk_rows", [1, 10, 64, 100_000])
@pytest.mark.parametrize("keys", [["key"], []])
def test_chunks_equal_windows(skewed, keys, chunk_rows):
    ordered = Ordered(skewed, keys, ["place", "id"], chunk_rows)
    ordered.position("position")
    ordered.previous(F.struct("id"), "before", F.col("id") % 5 == 0)
    ordered.running_sum(F.col("amount"), "total")
    got = ordered.frame().select(
        "id",
        "position",
        F.coalesce(F.col("before.id"), F.lit(-1)).alias("before"),
        F.coalesce("total", F.lit(-1)).alias("total"),
    )
    columns = ("id", "position", "before", "total")
    assert rows(got, *columns) == rows(expected(skewed, keys), *columns)


def test_only_large_groups_are_cut(skewed):
    ordered = Ordered(skewed, ["key"], ["place", "id"], 100)
    assert ordered.whole.where("key = 'hot'").count() == 0
    assert ordered.chunks.select("key").distinct().collect()[0][0] == "hot"
    assert ordered.chunks.count() + ordered.whole.count() == skewed.count()


def test_no_chunk_is_larger_than_asked(skewed):
    chunks = in_chunks(skewed, ["key"], ["place", "id"], 64)
    sizes = chunks.groupBy("_chunk").agg(F.count("*").alias("n"), F.min("_at"), F.max("_at"))
    assert sizes.agg(F.max("n")).first()[0] <= 64
    assert sizes.count() >= skewed.count() // 64


def test_order_may_be_descending(skewed):
    up = positions(skewed, ["key"], [F.desc("place"), F.desc("id")], "n", 50)
    w = Window.partitionBy("key").orderBy(F.desc("place"), F.desc("id"))
    plain = skewed.withColumn("n", F.row_number().over(w))
    assert rows(up, "id", "n") == rows(plain, "id", "n")


@pytest.mark.parametrize("chunk_rows", [16, 100_000])
def test_pages_keep_every_item(skewed, chunk_rows):
    item = F.col("id").cast("string")
    got = pages(skewed, ["key"], ["place", "id"], item, 30, ",", chunk_rows)
    assert got.agg(F.max("n_items")).first()[0] == 30
    by_key = {}
    for r in got.orderBy("key", "page").collect():
        by_key.setdefault(r.key, []).extend(r["items"].split(","))
    whole = {}
    for r in skewed.orderBy("place", "id").collect():
        whole.setdefault(r.key, []).append(str(r.id))
    assert by_key == whole


def test_empty_input(skewed):
    none = skewed.where("id < 0")
    assert positions(none, [], ["id"]).count() == 0
    assert positions(none, ["key"], ["id"]).count() == 0
