"""Circuit breaker over a stream of calls, as they come or in the order of their times."""

from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    ByteType,
    DataType,
    DateType,
    IntegerType,
    LongType,
    ShortType,
    StringType,
    StructField,
    StructType,
)

from textloom import fixed
from textloom.operators.breaker import CALL_FIELDS, CLOSED, OPEN, START, call
from textloom.session import new_folder
from textloom.streaming.run import drain

SLICE = 10_000
_STATE = StructType(
    [
        StructField("state", StringType()),
        StructField("failures", LongType()),
        StructField("last", LongType()),
    ]
)


def replay_stream(
    calls: DataFrame,
    keys: Sequence[str],
    seq: str,
    time: str,
    failed: str,
    threshold: int = fixed.FAILURE_THRESHOLD,
    recovery_seconds: float = fixed.RECOVERY_SECONDS,
) -> DataFrame:
    """As the batch replay, with the state of each key kept between micro-batches.

    Calls of one micro-batch are taken in the order of (time, seq); a call
    that comes in a later micro-batch is taken when it comes, whatever its
    time.  Only key, seq, time and outcome travel, as plain arrays, and the
    rate limit of the source bounds how many calls of a key are ordered at once.
    """
    recovery = round(recovery_seconds * 1_000_000)
    narrow = _narrow(calls, keys, seq, time, failed)
    out_names = [*keys, seq, *[f.name for f in CALL_FIELDS]]
    schema = StructType(
        [narrow.schema[k] for k in keys] + [StructField(seq, LongType())] + CALL_FIELDS
    )

    def step(key: tuple, batches: Iterator[pd.DataFrame], kept: GroupState):
        held = START
        if kept.exists:
            state, failures, last = kept.get
            held = (state, failures, None if state == CLOSED else last)
        parts = [(b["_t"].to_numpy(), b["_seq"].to_numpy(), b["_failed"].to_numpy()) for b in batches]
        at, number, bad = (np.concatenate(column) for column in zip(*parts))
        order = np.lexsort((number, at))
        for start in range(0, len(order), SLICE):
            some = order[start : start + SLICE]
            out = []
            for t, n, f in zip(at[some].tolist(), number[some].tolist(), bad[some].tolist()):
                admitted, outcome, held = call(held, t, f, threshold, recovery)
                out.append((*key, n, admitted, outcome, held[0], held[1]))
            yield pd.DataFrame(out, columns=out_names)
        state, failures, last = held
        kept.update((state, failures, last if last is not None else 0))

    return narrow.groupBy(*keys).applyInPandasWithState(
        step, schema, _STATE, "append", GroupStateTimeout.NoTimeout
    )


# ---- in the order of event time

#: Most calls of a key that wait for earlier ones.
MOST_HELD = 200_000
LATE = "late"
_BEFORE = -(1 << 62)
_ORDERED_STATE = StructType(
    _STATE.fields
    + [
        StructField("newest", LongType()),
        StructField("released", LongType()),
        StructField("at", ArrayType(LongType())),
        StructField("seq", ArrayType(LongType())),
        StructField("failed", ArrayType(BooleanType())),
    ]
)
_FRESH = (CLOSED, 0, 0, _BEFORE, _BEFORE, (), (), ())
#: Types of keys that come back from text as they were.
_PLAIN = (StringType, ByteType, ShortType, IntegerType, LongType, BooleanType, DateType)


def _narrow(calls: DataFrame, keys: Sequence[str], seq: str, time: str, failed: str) -> DataFrame:
    return calls.select(
        *keys,
        F.col(seq).cast("bigint").alias("_seq"),
        F.unix_micros(F.col(time).cast("timestamp")).alias("_t"),
        F.col(failed).cast("boolean").alias("_failed"),
    )


def replay_in_order(
    calls: DataFrame,
    keys: Sequence[str],
    seq: str,
    time: str,
    failed: str,
    delay_seconds: float,
    threshold: int = fixed.FAILURE_THRESHOLD,
    recovery_seconds: float = fixed.RECOVERY_SECONDS,
    idle_ms: int | None = None,
    most_held: int = MOST_HELD,
    key_groups: int | None = None,
) -> DataFrame:
    """As the batch replay for calls that come up to ``delay_seconds`` out of order.

    A key's watermark is the latest time it has shown in earlier micro-batches,
    less the delay.  Calls from the watermark on wait in the key's state, and are
    taken in the order of (time, seq) once it has passed them.  A call from before
    the watermark comes out at once, with ``late`` as admitted_as and outcome, and
    leaves the breaker as it is: late calls are counted, not lost.  (Spark's own
    watermark would drop them before any operator sees them.)

    Where more than ``most_held`` calls of a key would wait, the earliest go ahead
    and the watermark with them.  With ``idle_ms``, a key that shows nothing for so
    long no longer waits.  ``waiting`` has the calls that a stopped stream still holds.
    Calls without a time are late.

    A state for each key costs milliseconds for each key that a micro-batch shows.  With
    ``key_groups``, keys share so many states, each of which is written whole when one of
    its keys shows up: for many keys and large micro-batches.  Results are the same.  Keys that
    do not come back from text as they were, and ``idle_ms``, keep a state for each key.
    """
    narrow = _narrow(calls, keys, seq, time, failed)
    schema = StructType([narrow.schema[k] for k in keys] + [StructField(seq, LongType())] + CALL_FIELDS)
    limits = threshold, round(recovery_seconds * 1_000_000), round(delay_seconds * 1_000_000), most_held
    if key_groups and not idle_ms and all(isinstance(narrow.schema[k].dataType, _PLAIN) for k in keys):
        return _in_groups(narrow, keys, schema, limits, key_groups)

    def step(key: tuple, batches: Iterator[pd.DataFrame], kept: GroupState):
        over, left = kept.hasTimedOut, {}

        def rows() -> Iterator[tuple]:
            new = [_NO_CALLS] if over else [_NO_CALLS, *map(_arrays, batches)]
            new = [np.concatenate(column) for column in zip(*new)]
            left[key] = yield from _advance(key, kept.get if kept.exists else _FRESH, *new, *limits, over)

        yield from _frames(rows(), schema.names)
        kept.update(left[key])
        if idle_ms and left[key][-1]:
            kept.setTimeoutDuration(idle_ms)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return narrow.groupBy(*keys).applyInPandasWithState(step, schema, _ORDERED_STATE, "append", timeout)


_NO_CALLS = tuple(np.zeros(0, t) for t in (np.int64, np.int64, bool))


def _arrays(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Times, numbers and failures of calls; one without a time is from before all others."""
    at = batch["_t"].fillna(_BEFORE - 1).astype(np.int64).to_numpy()
    return at, batch["_seq"].to_numpy(), batch["_failed"].fillna(False).astype(bool).to_numpy()


def _frames(rows: Iterator[tuple], names: list[str]) -> Iterator[pd.DataFrame]:
    while some := list(islice(rows, SLICE)):
        yield pd.DataFrame(some, columns=names)


def _advance(
    key: tuple,
    kept: tuple,
    t: np.ndarray,
    n: np.ndarray,
    f: np.ndarray,
    threshold: int,
    recovery: int,
    delay: int,
    most_held: int,
    over: bool = False,
):
    """Rows of a key's calls that are late or need wait no longer; returns what is kept of it then."""
    state, failures, last, newest, released, *waiting = kept
    held = (state, failures, None if state == CLOSED else last)
    at, number, bad = (np.array(w, a.dtype) for w, a in zip(waiting, _NO_CALLS))
    if over:
        released = newest + 1
    else:
        good = t >= released
        for x in n[~good].tolist():
            yield (*key, x, LATE, LATE, held[0], held[1])
        at, number, bad = (np.concatenate((w, c[good])) for w, c in zip((at, number, bad), (t, n, f)))
        newest = max(newest, int(t.max(initial=_BEFORE)))
        released = max(released, newest - delay)
    order = np.lexsort((number, at))
    ready = int(np.searchsorted(at[order], released))
    if len(order) - ready > most_held:
        ready = len(order) - most_held
        released = int(at[order[ready - 1]]) + 1
        ready = int(np.searchsorted(at[order], released))
    for start in range(0, ready, SLICE):
        some = order[start : min(ready, start + SLICE)]
        for a, x, b in zip(at[some].tolist(), number[some].tolist(), bad[some].tolist()):
            admitted, outcome, held = call(held, a, b, threshold, recovery)
            yield (*key, x, admitted, outcome, held[0], held[1])
    rest = order[ready:]
    state, failures, last = held
    waiting = [w[rest].tolist() for w in (at, number, bad)]
    return (state, failures, last if last is not None else 0, newest, released, *waiting)


def _in_groups(calls: DataFrame, keys: Sequence[str], schema: StructType, limits: tuple, key_groups: int) -> DataFrame:
    """As a state for each key, with the keys of a group in one state, by their text."""
    names = [f"_k{i}" for i in range(len(keys))]
    texts = [F.col(k).cast("string").alias(n) for k, n in zip(keys, names)]
    grouped = calls.select(*texts, "_seq", "_t", "_failed").withColumn(
        "_group", F.pmod(F.xxhash64(*names), F.lit(key_groups))
    )
    out = StructType([StructField(n, StringType()) for n in names] + schema.fields[len(keys) :])
    key_field = StructField("key", ArrayType(StringType()))
    group_state = StructType([StructField("keys", ArrayType(StructType([key_field, *_ORDERED_STATE.fields])))])

    def step(_: tuple, batches: Iterator[pd.DataFrame], kept: GroupState):
        entries = {tuple(entry[0]): entry[1:] for entry in kept.get[0]} if kept.exists else {}

        def rows() -> Iterator[tuple]:
            shown: dict[tuple, int] = {}
            codes, new = [], []
            for b in batches:
                each = zip(*[b[n].astype(object).where(b[n].notna(), None).tolist() for n in names])
                codes.append(np.array([shown.setdefault(key, len(shown)) for key in each], np.int64))
                new.append(_arrays(b))
            code, *new = (np.concatenate(column) for column in zip(*[(c, *a) for c, a in zip(codes, new)]))
            order = np.argsort(code, kind="stable")
            ends = np.searchsorted(code[order], np.arange(len(shown) + 1))
            for key, k in shown.items():
                own = order[ends[k] : ends[k + 1]]
                entries[key] = yield from _advance(key, entries.get(key, _FRESH), *[c[own] for c in new], *limits)

        yield from _frames(rows(), out.names)
        kept.update(([(list(key), *entry) for key, entry in entries.items()],))

    found = grouped.groupBy("_group").applyInPandasWithState(
        step, out, group_state, "append", GroupStateTimeout.NoTimeout
    )
    own = [F.col(n).cast(f.dataType).alias(f.name) for n, f in zip(names, schema)]
    return found.select(*own, *schema.names[len(keys) :])


def waiting(
    spark: SparkSession,
    progress: str,
    keys: Sequence[str],
    seq: str,
    threshold: int = fixed.FAILURE_THRESHOLD,
    recovery_seconds: float = fixed.RECOVERY_SECONDS,
    types: dict[str, DataType] | None = None,
) -> DataFrame:
    """Outcomes of the calls that a stopped ``replay_in_order`` still holds, as if no earlier ones were to come.

    ``progress`` is the stream's checkpoint folder; a stream that goes on from it is not disturbed.
    Keys kept in groups are text, unless ``types`` names their types.
    """
    recovery = round(recovery_seconds * 1_000_000)
    state = spark.read.format("statestore").load(progress).select("key.*", "value.groupState.*")
    if "keys" in state.columns:  # keys in groups
        types = types or {}
        state = state.select(F.explode("keys").alias("_e")).select("_e.*")
        own = [F.col("key")[i].cast(types.get(k, "string")).alias(k) for i, k in enumerate(keys)]
        state = state.select(*own, *_ORDERED_STATE.names)
    schema = StructType([state.schema[k] for k in keys] + [StructField(seq, LongType())] + CALL_FIELDS)
    names = schema.names

    def rows(batch: pd.DataFrame) -> Iterator[tuple]:
        for row in batch.itertuples(index=False):
            *key, state, failures, last, at, number, bad = row
            held = (state, failures, last if state == OPEN else None)
            for t, n, f in zip(at, number, bad):
                admitted, outcome, held = call(held, int(t), bool(f), threshold, recovery)
                yield (*key, int(n), admitted, outcome, held[0], held[1])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield from _frames(rows(batch), names)

    held = state.where(F.size("at") > 0)
    return held.select(*keys, "state", "failures", "last", "at", "seq", "failed").mapInPandas(run, schema)


def replay_to_the_end(
    calls: DataFrame,
    keys: Sequence[str],
    seq: str,
    time: str,
    failed: str,
    delay_seconds: float,
    threshold: int = fixed.FAILURE_THRESHOLD,
    recovery_seconds: float = fixed.RECOVERY_SECONDS,
    most_held: int = MOST_HELD,
    folder: str | None = None,
    key_groups: int | None = None,
) -> DataFrame:
    """All calls of a stream once all that is there now has been read; the end of input ends the waiting."""
    folder = folder or new_folder(calls.sparkSession, "ordered-calls")
    options = {"most_held": most_held, "key_groups": key_groups}
    stream = replay_in_order(calls, keys, seq, time, failed, delay_seconds, threshold, recovery_seconds, **options)
    done = drain(stream, "ordered-calls", folder)
    types = {k: stream.schema[k].dataType for k in keys}
    rest = waiting(calls.sparkSession, f"{folder}/progress", keys, seq, threshold, recovery_seconds, types)
    return done.unionByName(rest)
