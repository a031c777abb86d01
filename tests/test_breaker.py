import tracemalloc

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from textloom.operators import breaker as B

RELAXED = settings(
    max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
CALLS = st.lists(st.tuples(st.integers(0, 60), st.booleans()), min_size=1, max_size=50)


def brute_force(calls, threshold, recovery):
    """(admitted as, outcome, state after, failures) by keeping the history of failures."""
    out, history, opened = [], [], False
    for at, failed in calls:
        trying = opened and at - history[-1] > recovery
        if opened and not trying:
            out.append(("open", "rejected", "open", len(history)))
            continue
        if failed:
            history.append(at)
            opened = len(history) >= threshold
        elif trying:
            history, opened = [], False
        out.append(
            (
                "half-open" if trying else "closed",
                "failure" if failed else "success",
                "open" if opened else "closed",
                len(history),
            )
        )
    return out


@given(CALLS, st.integers(1, 4), st.integers(0, 9), st.integers(1, 9))
def test_chunks_compose(calls, threshold, recovery, size):
    calls = sorted(calls, key=lambda c: c[0])
    held, got = B.START, []
    for start in range(0, len(calls), size):
        part = calls[start : start + size]
        state = held
        for at, failed in part:
            admitted, outcome, state = B.call(state, at, failed, threshold, recovery)
            got.append((admitted, outcome, state[0], state[1]))
        function = B.chunk_exits([a for a, _ in part], [f for _, f in part], threshold, recovery)
        held = B.leave(held, function, threshold, recovery)
        assert held[:2] == state[:2]
        assert held[0] == "closed" or held[2] == state[2]
    assert got == brute_force(calls, threshold, recovery)


@given(CALLS, st.integers(1, 4), st.integers(0, 9), st.integers(1, 5), st.integers(2, 4))
def test_functions_compose(calls, threshold, recovery, size, fan):
    """However chunks are joined, the function of all of them leads from any state where one chunk after the other leads."""
    calls = sorted(calls, key=lambda c: c[0])
    first = next((at for at, failed in calls if failed), calls[-1][0])
    parts = [calls[k : k + size] for k in range(0, len(calls), size)]
    nodes = [
        (p[0][0], B.chunk_exits([a for a, _ in p], [f for _, f in p], threshold, recovery, first))
        for p in parts
    ]
    singles = nodes
    while len(nodes) > 1:
        above = []
        for k in range(0, len(nodes), fan):
            start, function = nodes[k]
            for _, other in nodes[k + 1 : k + fan]:
                function = B.compose(function, other, start, threshold, recovery)
            above.append((start, function))
        nodes = above
    for entry in [("closed", n, None) for n in range(threshold)] + [
        ("open", threshold + 2, at) for at in range(first, calls[0][0] + 1)
    ]:
        held = entry
        for _, function in singles:
            held = B.leave(held, function, threshold, recovery)
        assert B.leave(entry, nodes[0][1], threshold, recovery) == held


def frame(spark, logs):
    rows = [
        (key, n, at, failed)
        for key, calls in logs.items()
        for n, (at, failed) in enumerate(sorted(calls, key=lambda c: c[0]))
    ]
    return (
        spark.createDataFrame(rows, "key string, n int, s int, failed boolean")
        .withColumn("at", F.timestamp_seconds("s"))
        .repartition(3)
    )


def replayed(df, **options):
    got = B.replay(df, ["key"], ["at", "n"], "at", "failed", **options).orderBy("key", "n")
    out = {}
    for r in got.collect():
        out.setdefault(r.key, []).append((r.admitted_as, r.outcome, r.state_after, r.failures))
    return out


@RELAXED
@given(st.dictionaries(st.sampled_from("abc"), CALLS, min_size=1), st.sampled_from([1, 4, 1000]))
def test_replay_against_brute_force(spark, logs, chunk_rows):
    got = replayed(frame(spark, logs), threshold=2, recovery_seconds=5, chunk_rows=chunk_rows)
    assert got == {
        k: brute_force(sorted(v, key=lambda c: c[0]), 2, 5) for k, v in logs.items()
    }


def test_known_cases(spark):
    F_, S = True, False
    logs = {
        "opens": [(0, F_), (1, F_), (2, F_), (3, S)],
        "successes between do not reset": [(0, F_), (1, S), (2, F_), (3, S), (4, F_), (5, S)],
        "exactly the recovery time": [(0, F_), (0, F_), (0, F_), (60, S), (61, S), (62, F_)],
        "half-open failure": [(0, F_), (0, F_), (0, F_), (61, F_), (100, S), (122, S)],
    }
    got = replayed(frame(spark, logs))
    outcomes = {k: [(o, s) for _, o, s, _ in v] for k, v in got.items()}
    fail, ok = "failure", "success"
    assert outcomes["opens"] == [
        (fail, "closed"), (fail, "closed"), (fail, "open"), ("rejected", "open")
    ]
    assert outcomes["successes between do not reset"][-2:] == [(fail, "open"), ("rejected", "open")]
    assert outcomes["exactly the recovery time"][3:] == [
        ("rejected", "open"), (ok, "closed"), (fail, "closed")
    ]
    assert outcomes["half-open failure"][3:] == [
        (fail, "open"), ("rejected", "open"), (ok, "closed")
    ]


def test_large_key_equals_small_one(spark, folder):
    """All events under one key: chunks of 50 give what one scan gives."""
    events = spark.read.parquet(f"{folder}/events.parquet").select(
        "event_id", "ts", (F.col("event_type") == "error").alias("failed"), F.lit(1).alias("key")
    )
    both = [
        sorted(
            map(
                tuple,
                B.replay(
                    events, ["key"], ["ts", "event_id"], "ts", "failed", 3, 7200, rows
                ).drop("ts").collect(),
            )
        )
        for rows in (50, 10_000)
    ]
    assert both[0] == both[1]
    assert {r[3] for r in both[0]} == {"closed", "open", "half-open"} or len(both[0]) == 1000


@pytest.mark.parametrize("fails", [lambda i: True, lambda i: i % 2 == 0, lambda i: i % 7 < 3])
def test_summaries_of_long_chunks_stay_small(fails):
    """A chunk has runs for the calls of its first recovery time only."""
    minute, n = 60_000_000, 20_000
    at = [i * 1_000_000 for i in range(n)]  # a call each second
    _, closing, runs = B.chunk_exits(at, [fails(i) for i in range(n)], 3, minute)
    assert len(closing) <= 3 and len(runs) <= 62


def large_key(spark, monkeypatch, calls, chunk_rows, recovery):
    """(levels, outcomes) of one key cut into chunks."""
    seen, levels = [], B._levels

    def kept(*args):
        seen.extend(levels(*args))
        return seen

    monkeypatch.setattr(B, "_levels", kept)
    got = replayed(
        frame(spark, {"k": calls}), threshold=3, recovery_seconds=recovery, chunk_rows=chunk_rows
    )
    return seen, got["k"]


def test_a_thousand_chunks_inside_one_recovery_time(spark, monkeypatch):
    """Each chunk is one small row, and no task is given more than FAN of them at a time."""
    calls = [(n // 100, n % 3 > 0) for n in range(10_000)]
    levels, got = large_key(spark, monkeypatch, calls, 10, 3600)
    assert got == brute_force(calls, 3, 3600)
    sizes = [level.count() for level in levels]
    assert sizes[0] >= 1000 and sizes[-1] == 1
    assert all(b <= -(-a // B.FAN) for a, b in zip(sizes, sizes[1:]))
    for level in levels:
        rows = level.select(F.size("until").alias("runs"), F.size("closing").alias("closing")).collect()
        assert max(r.runs for r in rows) == 0 and max(r.closing for r in rows) <= 3
        together = level.groupBy((F.col("_node") / B.FAN).cast("long")).count()
        assert together.agg(F.max("count")).first()[0] <= B.FAN


@pytest.mark.parametrize("most_runs", [1 << 17, 40])
def test_many_recovery_times(spark, monkeypatch, most_runs):
    """Also where functions would be too long to compose: their key then stays lower and gives the same."""
    calls = [(n // 4, n % 5 != 2 or n % 400 < 90) for n in range(4000)]
    monkeypatch.setattr(B, "MOST_RUNS", most_runs)
    levels, got = large_key(spark, monkeypatch, calls, 20, 30)
    assert got == brute_force(calls, 3, 30)
    assert (levels[-1].count() == 1) == (most_runs > 40)
    # Runs are calls of a recovery time at most, not all calls.
    assert all(r[0] <= 30 * 4 + 4 for level in levels for r in level.select(F.size("until")).collect())


def test_functions_are_followed_as_they_lie_in_arrow():
    """A batch of many long functions takes no Python memory but for the runs that are looked at."""
    functions, n = [], 500
    for k in range(200):
        at = [1_000 * (k * n + i) for i in range(n)]
        functions.append((at, [(k + i) % 3 > 0 for i in range(n)]))
    rows = [pa.table(B._function_columns(at[0], B.chunk_exits(at, bad, 3, n * 1_000))) for at, bad in functions]
    batch = pa.concat_tables(rows).combine_chunks().to_batches()[0]
    numbers = pa.array(range(len(rows)), pa.int64())
    ones = {"_key": pa.array([0] * len(rows)), "_parent": pa.array([-1] * len(rows)), "_chunk": numbers, "_node": numbers}
    start = {"_state": ["closed"] * len(rows), "_failures": pa.array([0] * len(rows), pa.int64()), "_last": pa.nulls(len(rows), pa.int64())}
    batch = pa.RecordBatch.from_pydict(ones | start | dict(zip(batch.schema.names, batch.columns)))
    tracemalloc.start()
    got = list(B._follow(iter([batch]), 3, n * 1_000))[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 << 20
    held = B.START
    for k, (at, bad) in enumerate(functions):
        assert tuple(got.column(c)[k].as_py() for c in ("_state", "_failures", "_last")) == held
        for t, f in zip(at, bad):
            held = B.call(held, t, f, 3, n * 1_000)[2]
