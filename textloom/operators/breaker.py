"""Circuit breaker replayed over a call log.

Per key the breaker is a state machine over the calls in time order, so it
cannot be an aggregate.  Keys of up to ``chunk_rows`` calls are scanned in one
pass over sorted partitions, holding one Arrow batch at a time.  The calls of
larger keys are cut into chunks: each chunk first works out, for every state
it could be entered in, the state it is left in.  These functions from state to
state are composed, FAN neighbours at a time, until a key has one; entry states
are then handed down the same way; and with its entry state known each chunk is
replayed by itself.  No step of this takes more than FAN of a key's functions.
"""

from bisect import bisect_right
from collections.abc import Iterator, Sequence
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from textloom import fixed
from textloom.operators.lookup import small
from textloom.operators.ordered import in_chunks, split_by_size
from textloom.session import written

CLOSED, OPEN, HALF_OPEN = "closed", "open", "half-open"
START = (CLOSED, 0, None)
CHUNK_ROWS = 200_000
#: Neighbouring functions composed into one, and most runs that they may have together.
FAN, MOST_RUNS = 16, 1 << 17
#: Runs for which a task that follows functions is made; it may hold them in one Arrow batch.
TASK_RUNS = 1 << 20

CALL_FIELDS = [
    StructField("admitted_as", StringType()),
    StructField("outcome", StringType()),
    StructField("state_after", StringType()),
    StructField("failures", LongType()),
]
_CALL_ARROW = [
    pa.field("admitted_as", pa.string()),
    pa.field("outcome", pa.string()),
    pa.field("state_after", pa.string()),
    pa.field("failures", pa.int64()),
]


def admit(held: tuple, at: int, recovery: int) -> tuple:
    """State at the start of a call: an open breaker lets a call try after the recovery time."""
    state, failures, last = held
    if state == OPEN and at - last > recovery:
        return HALF_OPEN, failures, last
    return held


def settle(held: tuple, at: int, failed: bool, threshold: int) -> tuple:
    """State after an admitted call.  Only a success while half-open forgets earlier failures."""
    state, failures, last = held
    if failed:
        failures += 1
        return (OPEN if failures >= threshold else state), failures, at
    return START if state == HALF_OPEN else held


def call(held: tuple, at: int, failed: bool, threshold: int, recovery: int) -> tuple:
    """(state as admitted, outcome, state after) of one call."""
    admitted = admit(held, at, recovery)
    if admitted[0] == OPEN:
        return OPEN, "rejected", admitted
    after = settle(admitted, at, failed, threshold)
    return admitted[0], "failure" if failed else "success", after


def _with_calls(batch, rows: list[tuple]):
    """The Arrow batch or table with the four call columns added."""
    columns = list(zip(*rows)) if rows else [(), (), (), ()]
    for field, values in zip(_CALL_ARROW, columns):
        batch = batch.append_column(field, pa.array(values, type=field.type))
    return batch


def _replay_batch(batch, held: dict, keys: Sequence[str], threshold: int, recovery: int):
    """Replay one sorted batch.  ``held`` keeps the key being scanned and its state."""
    names = list(zip(*[batch.column(k).to_pylist() for k in keys]))
    out = []
    for key, at, failed in zip(
        names, batch.column("_t").to_pylist(), batch.column("_failed").to_pylist()
    ):
        if key != held.get("key"):
            held["key"], held["state"] = key, START
        admitted, outcome, held["state"] = call(held["state"], at, failed, threshold, recovery)
        out.append((admitted, outcome, held["state"][0], held["state"][1]))
    return _with_calls(batch, out)


def _scan(
    batches: Iterator[pa.RecordBatch], keys: Sequence[str], threshold: int, recovery: int
) -> Iterator[pa.RecordBatch]:
    held: dict = {}
    for batch in batches:
        if batch.num_rows:
            yield _replay_batch(batch, held, keys, threshold, recovery)


# ---- chunks of large keys
#
# An exit is (state, failures, last, added): when ``added`` is true, the
# failures count on from those the chunk was entered with.

_EXIT = pa.struct(
    [
        ("state", pa.string()),
        ("failures", pa.int64()),
        ("last", pa.int64()),
        ("added", pa.bool_()),
    ]
)
_EXIT_TYPE = StructType(
    [
        StructField("state", StringType()),
        StructField("failures", LongType()),
        StructField("last", LongType()),
        StructField("added", BooleanType()),
    ]
)


def _counted(exit_: tuple, base: int) -> tuple:
    state, failures, last, added = exit_
    return (state, failures + base, last, added) if added else exit_


def chunk_exits(
    at: list[int],
    failed: list[bool],
    threshold: int,
    recovery: int,
    first_failure: int | None = None,
):
    """How a chunk of calls is left, for every way to enter it.

    Returns the number of failures in it, the exits for a closed breaker that
    opens inside it by failures still missing (1, 2, …), and for an open
    breaker the exits by the first call let through, as (time, exit) runs.

    An open breaker last failed before the chunk, so it lets a call through no
    later than the first one beyond the recovery time after the chunk's start:
    there are runs up to that call only, however long the chunk is.  It did not
    fail before ``first_failure``, the first one of the key, where that is
    known: there are no runs for calls within the recovery time after it.
    """
    n = len(at)
    failures = [i for i in range(n) if failed[i]]
    total = len(failures)
    opened: dict[int, tuple] = {}  # left after opening at a call
    probed: list[tuple] = [()] * n  # left when a call is the first one let through
    seen = total  # index in ``failures`` of the first failure at or after the current call

    def closed_from(index: int, missing: int) -> tuple:
        """Left when closed, with ``missing`` failures to go, before failure number ``index``."""
        if total - index < missing:
            return CLOSED, threshold - missing + total - index, None, False
        return _absolute(opened[failures[index + missing - 1]])

    def _absolute(exit_: tuple) -> tuple:
        return _counted(exit_, threshold)[:3] + (False,)

    for i in range(n - 1, -1, -1):
        if failed[i]:
            probe = bisect_right(at, at[i] + recovery)
            opened[i] = (OPEN, 0, at[i], True) if probe == n else probed[probe]
            probed[i] = _counted(opened[i], 1)
            seen -= 1
        else:
            probed[i] = closed_from(seen, threshold)
    closing = [closed_from(0, missing) for missing in range(1, min(threshold, total) + 1)]
    runs: list[tuple] = []
    reach = bisect_right(at, at[0] + recovery) + 1 if at else 0
    skip = 0 if first_failure is None else bisect_right(at, first_failure + recovery)
    for time, exit_ in zip(at[skip:reach], probed[skip:reach]):
        _add_run(runs, time, exit_)
    return total, closing, runs


def _add_run(runs: list[tuple], time: int, exit_: tuple) -> None:
    if runs and runs[-1][1] == exit_:
        runs[-1] = (time, exit_)
    else:
        runs.append((time, exit_))


def follow(exit_: tuple, function: tuple, threshold: int, recovery: int) -> tuple:
    """The exit from calls with ``function`` (total, closing, runs) that are entered at ``exit_``."""
    state, failures, last, added = exit_
    total, closing, runs = function
    if state == CLOSED:
        missing = threshold - failures
        return closing[missing - 1] if missing <= total else (CLOSED, failures + total, None, False)
    run = bisect_right(runs, last + recovery, key=lambda r: r[0])
    if run == len(runs):
        return exit_
    state_, more, last_, on = runs[run][1]
    # Where this exit counts on from its entry, it counts on from whatever the entry counts on from.
    return (state_, failures + more, last_, added) if on else runs[run][1]


def compose(first: tuple, second: tuple, start: int, threshold: int, recovery: int) -> tuple:
    """The function of calls with function ``first``, which begin at ``start``, and then ``second``.

    Runs of ``second`` are needed up to the first call beyond the recovery time after
    ``start`` only, and equal neighbours become one.
    """
    total = first[0] + second[0]
    closing = [
        follow(first[1][missing - 1], second, threshold, recovery)
        if missing <= first[0]
        else second[1][missing - first[0] - 1]
        for missing in range(1, min(threshold, total) + 1)
    ]
    runs: list[tuple] = []
    for time, exit_ in first[2]:
        _add_run(runs, time, follow(exit_, second, threshold, recovery))
    beyond = first[2][-1][0] if first[2] else None
    if beyond is None or beyond <= start + recovery:
        for time, exit_ in second[2]:
            if beyond is None or time > beyond:
                _add_run(runs, time, exit_)
            if time > start + recovery:
                break
    return total, closing, runs


def leave(held: tuple, function: tuple, threshold: int, recovery: int) -> tuple:
    """State after calls with ``function`` (total, closing, runs) that were entered as ``held``."""
    return follow((*held, False), function, threshold, recovery)[:3]


_FUNCTION_FIELDS = [
    StructField("start", LongType()),
    StructField("total", LongType()),
    StructField("closing", ArrayType(_EXIT_TYPE)),
    StructField("until", ArrayType(LongType())),
    StructField("exits", ArrayType(_EXIT_TYPE)),
]
_FUNCTION = [f.name for f in _FUNCTION_FIELDS]


def _exits(exits: Sequence[tuple]) -> pa.Array:
    """One list that holds the exits."""
    columns = list(zip(*exits)) if exits else [()] * len(_EXIT)
    each = [pa.array(values, field.type) for values, field in zip(columns, _EXIT)]
    return pa.ListArray.from_arrays([0, len(exits)], pa.StructArray.from_arrays(each, fields=list(_EXIT)))


def _function_columns(start: int, function: tuple) -> dict:
    total, closing, runs = function
    return {
        "start": pa.array([start], pa.int64()),
        "total": pa.array([total], pa.int64()),
        "closing": _exits(closing),
        "until": pa.array([[t for t, _ in runs]], pa.list_(pa.int64())),
        "exits": _exits([e for _, e in runs]),
    }


def _tuples(exits: pa.StructArray) -> list[tuple]:
    return list(zip(*[column.to_pylist() for column in exits.flatten()]))


class _Runs(Sequence):
    """The runs of a function as they lie in Arrow; those that are looked at become Python objects."""

    def __init__(self, until: pa.Array, exits: pa.StructArray):
        self.until, self.exits = until, exits

    def __len__(self) -> int:
        return len(self.until)

    def __getitem__(self, k: int) -> tuple:
        return self.until[k].as_py(), tuple(self.exits[k].as_py().values())

    def all(self) -> list[tuple]:
        return list(zip(self.until.to_pylist(), _tuples(self.exits)))


def _function_of(rows: pa.RecordBatch | pa.Table, k: int) -> tuple:
    """The function in row ``k``, with its runs still in Arrow."""
    total, closing, until, exits = (rows.column(c)[k] for c in ("total", "closing", "until", "exits"))
    return total.as_py(), _tuples(closing.values), _Runs(until.values, exits.values)


def _summarise(table: pa.Table, threshold: int, recovery: int) -> pa.Table:
    table = table.sort_by("_at")
    at = table.column("_t").to_pylist()
    failures = table.column("_first")[0].as_py()
    # Without any failure of the key the breaker is never open.
    first = at[-1] if failures is None else failures
    function = chunk_exits(at, table.column("_failed").to_pylist(), threshold, recovery, first)
    names = {c: table.column(c).slice(0, 1) for c in ("_key", "_chunk")}
    return pa.table(names | _function_columns(at[0], function))


def _composed(table: pa.Table, threshold: int, recovery: int) -> pa.Table:
    """One function of up to FAN neighbours, named after the first of them."""
    table = table.sort_by("_node")
    start, function = table.column("start")[0].as_py(), None
    for k in range(table.num_rows):
        total, closing, runs = _function_of(table, k)
        own = total, closing, runs.all()
        function = own if function is None else compose(function, own, start, threshold, recovery)
    names = {c: table.column(c).slice(0, 1) for c in ("_key", "_chunk")}
    node = pa.array([table.column("_node")[0].as_py() // FAN], pa.int64())
    return pa.table(names | {"_node": node} | _function_columns(start, function))


def _follow(
    batches: Iterator[pa.RecordBatch], threshold: int, recovery: int
) -> Iterator[pa.RecordBatch]:
    """Entry state of each node, over rows sorted by key, parent and node with the parent's entry state."""
    group, held = None, START
    for batch in batches:
        entries = []
        narrow = batch.select(["_key", "_parent", "_state", "_failures", "_last"]).to_pylist()
        for k, row in enumerate(narrow):
            if (row["_key"], row["_parent"]) != group:
                group = (row["_key"], row["_parent"])
                held = (row["_state"], row["_failures"], row["_last"])
            entries.append(held)
            held = leave(held, _function_of(batch, k), threshold, recovery)
        state, failures, last = zip(*entries) if entries else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("_key"),
                batch.column("_chunk"),
                batch.column("_node"),
                pa.array(state, pa.string()),
                pa.array(failures, pa.int64()),
                pa.array(last, pa.int64()),
            ],
            names=["_key", "_chunk", "_node", "_state", "_failures", "_last"],
        )


def _levels(leaves: DataFrame, threshold: int, recovery: int) -> list[DataFrame]:
    """Functions of the chunks, of FAN neighbours each, of FAN of those, … until each key has one.

    A key whose neighbours would have more than MOST_RUNS runs together goes no further up.
    """
    levels = [leaves]
    schema = StructType([leaves.schema[c] for c in ("_key", "_chunk", "_node")] + _FUNCTION_FIELDS)

    def composed(functions: pa.Table) -> pa.Table:
        return _composed(functions, threshold, recovery)

    parent = F.floor(F.col("_node") / FAN).alias("_parent")
    while True:
        sums = levels[-1].groupBy("_key", parent).agg(F.sum(F.size("until")).alias("runs"))
        sums = sums.groupBy("_key").agg(F.max("runs").alias("runs"))
        many = levels[-1].groupBy("_key").agg(F.max("_node").alias("last"))
        on = many.where("last > 0").join(sums.where(F.col("runs") <= MOST_RUNS), "_key").select("_key")
        on = written(on, "composed-keys")
        if on.isEmpty():
            return levels
        below = levels[-1].join(small(on), "_key", "left_semi")
        levels.append(written(below.groupBy("_key", parent).applyInArrow(composed, schema), "functions"))


def _entries(levels: list[DataFrame], threshold: int, recovery: int) -> DataFrame:
    """(_key, _chunk, _node, _state, _failures, _last): the state in which each chunk is entered."""
    above = None
    own = ["_key", "_chunk", "_node", *_FUNCTION]
    state = ["_state", "_failures", "_last"]
    start = [F.lit(v).cast(t).alias(c) for v, t, c in zip(START, ("string", "long", "long"), state)]
    for level in reversed(levels):
        # A key that went no further up is entered closed, and its nodes are one sequence.
        if above is None:
            rows = level.select(*own, F.lit(-1).cast("long").alias("_parent"), *start)
        else:
            entered = above.select("_key", F.col("_node").alias("_parent"), *state, F.lit(True).alias("_has"))
            rows = level.withColumn("_parent", F.floor(F.col("_node") / FAN)).join(
                entered, ["_key", "_parent"], "left"
            )
            known = F.col("_has").isNotNull()
            rows = rows.select(
                *own,
                F.when(known, F.col("_parent")).otherwise(-1).cast("long").alias("_parent"),
                *[F.when(known, F.col(c)).otherwise(s).alias(c) for c, s in zip(state, start)],
            )
        schema = StructType(
            [level.schema[c] for c in ("_key", "_chunk", "_node")]
            + [StructField("_state", StringType()), StructField("_failures", LongType()), StructField("_last", LongType())]
        )
        runs = level.agg(F.sum(F.size("until"))).first()[0] or 0
        dealt = rows.repartition(max(1, -(-runs // TASK_RUNS)), "_key", "_parent")
        sorted_ = dealt.sortWithinPartitions("_key", "_parent", "_node")
        above = sorted_.mapInArrow(partial(_follow, threshold=threshold, recovery=recovery), schema)
    return above


def _replay_chunk(
    table: pa.Table, columns: Sequence[str], threshold: int, recovery: int
) -> pa.Table:
    table = table.sort_by("_at")
    state = tuple(table.column(c)[0].as_py() for c in ("_state", "_failures", "_last"))
    out = []
    for at, failed in zip(table.column("_t").to_pylist(), table.column("_failed").to_pylist()):
        admitted, outcome, state = call(state, at, failed, threshold, recovery)
        out.append((admitted, outcome, state[0], state[1]))
    return _with_calls(table.select(list(columns)), out)


def _replay_large(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    schema: StructType,
    threshold: int,
    recovery: int,
    chunk_rows: int,
) -> DataFrame:
    chunks = in_chunks(df, keys, order, chunk_rows)
    group = [chunks.schema["_key"], StructField("_chunk", LongType())]

    def summarise(calls: pa.Table) -> pa.Table:
        return _summarise(calls, threshold, recovery)

    def replay_chunk(calls: pa.Table) -> pa.Table:
        return _replay_chunk(calls, columns, threshold, recovery)

    # A row per large key, of which there are no more than calls / chunk_rows.
    firsts = chunks.groupBy("_key").agg(F.min(F.when(F.col("_failed"), F.col("_t"))).alias("_first"))
    calls = chunks.select("_key", "_chunk", "_at", "_t", "_failed").join(small(written(firsts, "firsts")), "_key")
    summaries = calls.groupBy("_key", "_chunk").applyInArrow(summarise, StructType(group + _FUNCTION_FIELDS))
    summaries = written(summaries, "functions")
    place = F.row_number().over(Window.partitionBy("_key").orderBy("_chunk")) - 1
    places = summaries.select("_key", "_chunk", place.cast("long").alias("_node"))
    leaves = written(summaries.join(places, ["_key", "_chunk"]), "functions")
    levels = _levels(leaves, threshold, recovery)
    entries = _entries(levels, threshold, recovery).drop("_node")
    entered = chunks.join(entries, ["_key", "_chunk"])
    return entered.groupBy("_key", "_chunk").applyInArrow(replay_chunk, schema)


def replay(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    time: str,
    failed: str,
    threshold: int = fixed.FAILURE_THRESHOLD,
    recovery_seconds: float = fixed.RECOVERY_SECONDS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add to each call how a breaker per key would have treated it.

    ``order`` is a total order that follows ``time``, the start of the call.
    Adds admitted_as (closed, half-open or open), outcome (success, failure
    or rejected), state_after and failures.
    """
    keys, order = list(keys), list(order)
    recovery = round(recovery_seconds * 1_000_000)
    calls = df.withColumn("_t", F.unix_micros(F.col(time).cast("timestamp"))).withColumn(
        "_failed", F.col(failed).cast("boolean")
    )
    schema = StructType(
        df.schema.fields
        + [StructField("_t", LongType()), StructField("_failed", BooleanType())]
        + CALL_FIELDS
    )
    whole, large = split_by_size(calls, keys, chunk_rows)
    parts = []
    if whole is not None:
        by_key = whole.repartition(*keys).sortWithinPartitions(*keys, *order)
        scan = partial(_scan, keys=keys, threshold=threshold, recovery=recovery)
        parts.append(by_key.mapInArrow(scan, schema))
    if large is not None:
        parts.append(
            _replay_large(
                large, keys, order, calls.columns, schema, threshold, recovery, chunk_rows
            )
        )
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.drop("_t", "_failed")
