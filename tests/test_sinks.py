"""Sinks that are written to more than once: split streams and tables of newest rows."""

import os

import pytest
from pyspark.sql import functions as F

from textloom.operators.catalogue import last_wins
from textloom.sources.sinks import newest_rows, split_stream, upsert
from textloom.streaming.run import files_stream


def split(batch):
    return batch.withColumn("status", F.when(F.col("v") % 3 == 0, "failed").otherwise("ok"))


def files(path):
    return {
        os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns
        for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")
    }


def test_a_repeated_batch_leaves_no_repeated_row(spark, tmp_path):
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    for part in range(3):
        spark.range(part * 10, part * 10 + 10).select(F.col("id").alias("v")).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: files_stream(spark, source, spark.read.parquet(source).schema, maxFilesPerTrigger=1)
    runs = []

    def breaks(batch):
        """Fails after the rows of the second batch have been written."""
        runs.append(1)
        rows = split(batch)
        return rows.withColumn("v", F.expr("if(v >= 15 and v < 20, raise_error('lost'), v)")) if len(runs) == 3 else rows

    with pytest.raises(Exception, match="lost"):
        split_stream(stream(), out, progress, breaks)
    # As where a run ends after its batch was written, but before that was put down.
    split_stream(stream(), out, progress, split)
    last = max(int(n) for n in os.listdir(f"{progress}/commits") if n.isdigit())
    os.remove(f"{progress}/commits/{last}")
    for crc in (f"{progress}/commits/.{last}.crc",):
        if os.path.exists(crc):
            os.remove(crc)
    got = split_stream(stream(), out, progress, split)
    assert sorted(r.v for r in got.collect()) == list(range(30))
    failed = got.where("status = 'failed'")
    assert sorted(r.v for r in failed.collect()) == list(range(0, 30, 3))
    assert "PartitionFilters: [isnotnull(status" in failed._jdf.queryExecution().executedPlan().toString()
    # Another stream into the same folder overwrites nothing.
    again = split_stream(stream(), out, str(tmp_path / "other"), split)
    assert again.count() == 60 and again.select("stream").distinct().count() == 2


def test_a_stream_without_rows(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(0).select(F.col("id").alias("v")).write.parquet(source)
    stream = files_stream(spark, source, spark.range(1).select(F.col("id").alias("v")).schema)
    got = split_stream(stream, str(tmp_path / "out"), str(tmp_path / "progress"), split)
    assert got.columns == ["v", "stream", "batch", "status"] and got.count() == 0
    clash = stream.withColumn("Batch", F.lit(1))
    with pytest.raises(ValueError, match="batch"):
        split_stream(clash, str(tmp_path / "out2"), str(tmp_path / "progress2"), split)


def test_three_batches_equal_one_pass(spark, folder, tmp_path):
    events = spark.read.parquet(f"{folder}/events.parquet").select("user_id", "ts", "event_id", "event_type")
    path = str(tmp_path / "newest")
    # In no order, with rows in common, and one of them twice.
    for part in (2, 0, 1, 0):
        kept = upsert(events.where(F.col("event_id") % 4 >= part), path, ["user_id"], ["ts", "event_id"], 8)
    want = last_wins(events, "user_id", F.struct("ts", "event_id"), F.col("event_type"), "event_type")
    rows = [sorted(map(tuple, d.select("user_id", "event_type").collect())) for d in (kept, want)]
    assert rows[0] == rows[1]


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = str(tmp_path / "newest")
    rows = [(k, 1, f"v{k}") for k in range(1000)] + [(None, 1, "none"), (None, None, "older")]
    table = upsert(spark.createDataFrame(rows, "k long, at int, v string"), path, ["k"], ["at"], 16)
    assert table.count() == 1001 and table.where("k is null").first().v == "none"
    before = files(path)
    change = [(7, 2, "new"), (7, 0, "late"), (8, 0, "late")]
    table = upsert(spark.createDataFrame(change, "k long, at int, v string"), path, ["k"], ["at"], 16)
    after = files(path)
    assert {r.k: r.v for r in table.where("k in (7, 8, 9)").collect()} == {7: "new", 8: "v8", 9: "v9"}
    assert table.count() == 1001
    touched = {r[0] for r in table.where("k in (7, 8)").select("bucket_of_16").collect()}
    same = {f for f in before if after.get(f) == before[f]}
    assert {int(f.split("bucket_of_16=")[1].split("/")[0]) for f in before.keys() - same} == touched
    assert len(before) - len(same) <= 2 and len(same) >= 14


def test_no_changes_other_buckets_and_clashing_names(spark, tmp_path):
    path, schema = str(tmp_path / "newest"), "k long, at int, v string"
    none = spark.createDataFrame([], schema)
    assert upsert(none, path, ["k"], ["at"], 4).count() == 0
    ties = spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (1, 1, "b")], schema)
    first = [r.v for r in upsert(ties, path, ["k"], ["at"], 4).collect()]
    assert len(first) == 1 and [r.v for r in upsert(ties, path, ["k"], ["at"], 4).collect()] == first
    with pytest.raises(ValueError, match="bucket_of_4"):
        newest_rows(spark, path, none.schema, 8)
    with pytest.raises(ValueError, match="bucket_of_4"):
        upsert(ties.withColumn("Bucket_of_4", F.lit(1)), path, ["k"], ["at"], 4)
