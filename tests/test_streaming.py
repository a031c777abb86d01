import time

import pytest
from pyspark.sql import functions as F

from textloom.operators.breaker import replay
from textloom.operators.lines import assemble_lines
from textloom.queries import QUERIES
from textloom.sources.texts import text_lines
from textloom.streaming.breaker import LATE, replay_stream, replay_to_the_end
from textloom.streaming.lines import assemble_stream, assemble_to_the_end
from textloom.streaming.run import drain, files_stream


@pytest.fixture(scope="module")
def calls(spark, folder, tmp_path_factory):
    """Events in four files, one after the other in time."""
    path = str(tmp_path_factory.mktemp("calls") / "in")
    events = spark.read.parquet(f"{folder}/events.parquet").select(
        "event_id", "user_id", "ts", (F.col("event_type") == "error").alias("failed")
    )
    for part in range(4):
        some = events.where(f"event_id between {part * 250} and {part * 250 + 249}")
        some.coalesce(1).write.mode("append").parquet(path)
    return path


def test_breaker_keeps_its_state_between_batches(spark, calls):
    batch = spark.read.parquet(calls)
    stream = files_stream(spark, calls, batch.schema, maxFilesPerTrigger=1)
    got = drain(
        replay_stream(stream, ["user_id"], "event_id", "ts", "failed", 3, 86_400), "breaker-test"
    )
    wanted = replay(batch, ["user_id"], ["ts", "event_id"], "ts", "failed", 3, 86_400)
    columns = ["user_id", "event_id", "admitted_as", "outcome", "state_after", "failures"]
    rows = [sorted(map(tuple, d.select(*columns).collect())) for d in (got, wanted)]
    assert len(rows[0]) == 1000 and rows[0] == rows[1]
    assert {"half-open", "open"} <= {r[2] for r in rows[0]}


@pytest.fixture(scope="module")
def shuffled(spark, folder, tmp_path_factory):
    """Events in four files, each with events of all times."""
    path = str(tmp_path_factory.mktemp("shuffled") / "in")
    events = spark.read.parquet(f"{folder}/events.parquet").select(
        "event_id", "user_id", "ts", (F.col("event_type") == "error").alias("failed")
    )
    for part in range(4):
        events.where(f"event_id * 31 % 97 % 4 = {part}").coalesce(1).write.mode("append").parquet(path)
    return path


@pytest.mark.parametrize("delay_days,held", [(40, 200_000), (40, 1), (5, 200_000), (0, 200_000)])
def test_breaker_in_the_order_of_time(spark, shuffled, delay_days, held):
    """With time to wait, shuffled calls give the batch result; else some are late, and none is lost."""
    batch = spark.read.parquet(shuffled)
    stream = files_stream(spark, shuffled, batch.schema, maxFilesPerTrigger=1)
    args = ["user_id"], "event_id", "ts", "failed"
    got = replay_to_the_end(stream, *args, delay_days * 86_400, 3, 86_400, most_held=held)
    columns = ["user_id", "event_id", "admitted_as", "outcome", "state_after", "failures"]
    rows = sorted(map(tuple, got.select(*columns).collect()))
    assert len(rows) == 1000 == len({r[1] for r in rows})
    late = {r[1] for r in rows if r[3] == LATE}
    assert bool(late) == (delay_days < 40 or held == 1)
    # What is not late comes out as if the late calls had never been.
    rest = batch.where(~F.col("event_id").isin(sorted(late))) if late else batch
    wanted = replay(rest, ["user_id"], ["ts", "event_id"], "ts", "failed", 3, 86_400)
    assert [r for r in rows if r[1] not in late] == sorted(map(tuple, wanted.select(*columns).collect()))


@pytest.mark.parametrize("delay_days,held", [(40, 200_000), (40, 1), (5, 200_000)])
def test_keys_in_groups(spark, shuffled, delay_days, held):
    """Keys that share states, those without a value too, fare as with a state of their own."""
    batch = spark.read.parquet(shuffled)
    found = []
    for groups in (None, 4):
        stream = files_stream(spark, shuffled, batch.schema, maxFilesPerTrigger=1)
        stream = stream.withColumn("user_id", F.expr("if(user_id % 5 = 0, null, user_id)"))
        stream = stream.withColumn("n", F.lit("a b"))
        args = ["user_id", "n"], "event_id", "ts", "failed", delay_days * 86_400, 3, 86_400
        got = replay_to_the_end(stream, *args, most_held=held, key_groups=groups)
        found.append((got.dtypes, sorted(map(repr, got.collect()))))
    assert len(found[0][1]) == 1000 and found[0] == found[1]


def test_restart_goes_on(spark, calls, tmp_path):
    schema = spark.read.parquet(calls).schema
    for _ in range(2):
        stream = files_stream(spark, calls, schema, maxFilesPerTrigger=2)
        got = drain(
            replay_stream(stream, ["user_id"], "event_id", "ts", "failed"), "x", str(tmp_path / "run")
        )
        assert got.count() == 1000


@pytest.mark.parametrize("page_lines,page_bytes", [(1000, 1 << 26), (7, 1 << 26), (1000, 60), (9, 75)])
def test_lines(spark, folder, tmp_path, page_lines, page_bytes):
    """All texts, those without a terminator too, as the batch form gives them."""
    turns = spark.read.parquet(f"{folder}/conversations.parquet").withColumn(
        "text", F.replace("text", F.lit(" "), F.lit("\n"))
    )
    path = str(tmp_path / "in")
    for part in range(3):
        turns.where(f"turn % 3 = {part}" if part < 2 else "false").coalesce(1).write.mode(
            "append"
        ).parquet(path)
    early = spark.read.parquet(path)
    lines = text_lines(
        files_stream(spark, path, early.schema, maxFilesPerTrigger=10), "text", "conv_id", "turn"
    )
    limits = {"page_lines": page_lines, "page_bytes": page_bytes}
    got = assemble_to_the_end(lines, ["conv_id"], ["turn", "line_no"], "line", "at", **limits)
    batch_lines = text_lines(early, "text", "conv_id", "turn")
    wanted = assemble_lines(batch_lines, ["conv_id"], ["turn", "line_no"], "line", "at", **limits)
    columns = ["conv_id", "page", "n_lines", "text"]
    rows = [sorted(map(tuple, d.select(*columns).collect())) for d in (got, wanted)]
    assert rows[0] == rows[1]
    ended = batch_lines.where("lower(trim(line)) = 'at'").select("conv_id").distinct().count()
    assert 0 < ended < len({r[0] for r in rows[0]})


def test_lines_end_when_idle(spark, tmp_path):
    """Without a terminator a session ends once no line has come for a while."""
    path = str(tmp_path / "in")
    rows = [("a", 1, " x "), ("a", 2, "y "), ("a", 3, "")]
    spark.createDataFrame(rows, "s string, n int, line string").write.parquet(path)
    stream = files_stream(spark, path, spark.read.parquet(path).schema)
    query = (
        assemble_stream(stream, ["s"], ["n"], idle_ms=100)
        .writeStream.format("memory")
        .queryName("idle_lines")
        .option("checkpointLocation", str(tmp_path / "run"))
        .trigger(processingTime="200 milliseconds")
        .start()
    )
    try:
        give_up = time.time() + 60
        while spark.table("idle_lines").isEmpty() and time.time() < give_up:
            time.sleep(0.5)
    finally:
        query.stop()
    assert [tuple(r) for r in spark.table("idle_lines").collect()] == [("a", 0, 2, "x \ny")]


@pytest.mark.parametrize("name,source", [("line_stream", "conversations"), ("breaker_stream", "events"), ("ok_error_stream", "customer")])
def test_tables_in_folders(spark, folder, tmp_path, name, source):
    """A table is streamed alike as one file and as a folder of files."""
    for other in ("conversations", "events", "customer", "nation"):
        table = spark.read.parquet(f"{folder}/{other}.parquet")
        table.repartition(3 if other == source else 1).write.parquet(str(tmp_path / f"{other}.parquet"))
    query = QUERIES[name][0]
    got, wanted = query(spark, str(tmp_path)), query(spark, folder)
    rows = [sorted(map(repr, d.select(*wanted.columns).collect())) for d in (got, wanted)]
    assert rows[0] and rows[0] == rows[1]
