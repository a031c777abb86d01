import pytest
from pyspark.sql import functions as F

from textloom.sources.snapshots import fetched, versions


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_age_force_and_empty_fetches(spark, tmp_path):
    place, loads = str(tmp_path), []

    def job(at, rows, force=False):
        def load():
            loads.append(rows)
            return spark.range(*rows)

        return ids(fetched(spark, place, load, 60, force, lambda: at))

    assert job(0, (0, 3)) == [0, 1, 2]
    assert job(59.9, (5, 6)) == [0, 1, 2]
    assert job(60, (5, 7)) == [5, 6]
    assert job(61, (8, 9), force=True) == [8]
    assert job(62, (9, 9), force=True) == []
    assert job(63, (1, 2)) == [1]
    assert loads == [(0, 3), (5, 7), (8, 9), (9, 9), (1, 2)]
    assert versions(spark, place).count() == 5


def test_a_fetch_that_failed_halfway_is_never_seen(spark, tmp_path):
    place = str(tmp_path)
    kept = fetched(spark, place, lambda: spark.range(4), 60, now=lambda: 0)

    def breaks():
        return spark.range(100).select((F.col("id") / F.when(F.col("id") < 90, 1).otherwise(0)).cast("long").alias("id"))

    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        fetched(spark, place, breaks, 60, True, lambda: 10)
    assert ids(fetched(spark, place, lambda: spark.range(9), 60, now=lambda: 20)) == [0, 1, 2, 3]
    assert ids(fetched(spark, place, lambda: spark.range(2), 60, now=lambda: 80)) == [0, 1]
    # Who has read an older version goes on reading it.
    assert ids(kept) == [0, 1, 2, 3]


def test_two_jobs_that_fetch_at_once(spark, tmp_path):
    place = str(tmp_path)
    inner = []

    def slow():
        inner.append(fetched(spark, place, lambda: spark.range(5, 7), 60, now=lambda: 1))
        return spark.range(3)

    outer = fetched(spark, place, slow, 60, now=lambda: 0)
    assert (ids(outer), ids(inner[0])) == ([0, 1, 2], [5, 6])
    assert ids(fetched(spark, place, lambda: spark.range(1), 60, now=lambda: 2)) == [5, 6]
