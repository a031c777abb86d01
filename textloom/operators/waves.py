"""Calls through one breaker per model for all tasks together.

A task can only know its own calls, so a breaker that all tasks share is moved on
between waves.  A wave takes a bounded number of rows of each model; its calls are
made by many tasks at once; their outcomes are then added up per model, and the
state they leave decides what the next wave may call.
"""

import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from textloom import fixed
from textloom.operators.breaker import CLOSED, HALF_OPEN, OPEN
from textloom.operators.inference import REJECTED, Factory, run_callable
from textloom.operators.lookup import fits_broadcast
from textloom.operators.ordered import positions
from textloom.session import new_folder, written

WAVE_ROWS = 10_000
Mark = Callable[[DataFrame], DataFrame]


def _rejected(rows: DataFrame, model: str) -> DataFrame:
    """Rows that the breaker does not let through, with the columns of called ones."""
    before, after = fixed.MSG_BREAKER_OPEN.split("{key}")
    nothing = F.lit(None).cast("string")
    message = F.concat(F.lit(before), F.coalesce(F.col(model).cast("string"), F.lit("None")), F.lit(after))
    asked = F.col("_asked")
    return rows.select(
        "*",
        nothing.alias("result"),
        F.when(asked, message).alias("call_error"),
        F.when(asked, F.lit(REJECTED)).alias("error_type"),
        F.lit(0).alias("attempts"),
        F.lit(0).cast("bigint").alias("elapsed_ms"),
    )


def _after(states: DataFrame, done: DataFrame, model: str, at: int, threshold: int, mark: Mark) -> DataFrame:
    """States once the called rows of ``done`` are added up; failures count from when they were made."""
    failed = F.count(F.when(F.col("_asked") & F.col("call_error").isNotNull(), 1))
    called = done.groupBy(F.col(model).alias("_m")).agg(
        failed.alias("_failed"), F.count(F.when(F.col("_asked"), 1)).alias("_called")
    )
    joined = states.join(mark(called), states[model].eqNullSafe(F.col("_m")), "left")
    n, calls = F.coalesce("_failed", F.lit(0)), F.coalesce("_called", F.lit(0))
    total = F.col("failures") + n
    closes = (F.col("state") == HALF_OPEN) & (n == 0) & (calls > 0)
    opens = (n > 0) & (total >= threshold)
    state = F.when(closes, CLOSED).when(opens, OPEN).otherwise(F.col("state"))
    last = F.when(n > 0, F.lit(at)).otherwise(F.col("last"))
    left = joined.select(
        states[model], state.alias("state"), F.when(closes, 0).otherwise(total).alias("failures"), last.alias("last")
    )
    return written(left, "breaker-states")


def run_in_waves(
    df: DataFrame,
    factory: Factory,
    model: str,
    order: Sequence[str],
    prompt: str = "prompt",
    wave_rows: int = WAVE_ROWS,
    threshold: int = fixed.FAILURE_THRESHOLD,
    recovery_seconds: float = fixed.RECOVERY_SECONDS,
    now: Callable[[], float] = time.time,
    first_rows: int | None = None,
    **options,
) -> DataFrame:
    """As ``run_callable``, with one breaker per model for the whole job.

    Each model's rows are taken in the order of ``order``, ``wave_rows`` of them in a
    wave.  A closed breaker lets a wave through; its failures are counted when it is
    over, so a dead model costs one wave, not one wave per task.  An open one rejects a
    wave, and after the recovery time lets the wave's first call try: with an answer the
    rest of the wave follows, without one it is rejected.  Rows without a prompt are
    passed on without a call.  Rows without a model share one breaker.  With
    ``first_rows``, the first wave has so many rows of each model: with as many as the
    threshold, a model that is dead from the start is called for no more than those.
    """
    recovery = round(recovery_seconds * 1_000_000)
    # Places are found without the prompts, of which a task would else hold a whole model's.
    rows = written(df.withColumn("_row", F.monotonically_increasing_id()), "wave-rows")
    narrow = rows.select(*dict.fromkeys(("_row", model, *order)))
    places = positions(narrow, [model], [*order, "_row"], "_place").select("_row", "_place")
    placed = rows.join(places, "_row").select(*df.columns, "_place")
    first = wave_rows if first_rows is None else first_rows
    later = F.floor((F.col("_place") - 1 - first) / wave_rows) + 1
    wave = F.when(F.col("_place") <= first, 0).otherwise(later)
    placed = placed.withColumn("_asked", F.col(prompt).isNotNull()).withColumn("_wave", wave)
    path, out = new_folder(df.sparkSession, "waves"), new_folder(df.sparkSession, "wave-results")
    placed.write.partitionBy("_wave").parquet(path)
    todo = df.sparkSession.read.schema(placed.schema).parquet(path)
    models = todo.groupBy(model).agg(F.max("_wave").alias("waves"))
    waves = models.agg(F.max("waves")).first()[0]
    fresh = [F.lit(CLOSED).alias("state"), F.lit(0).cast("bigint").alias("failures"), F.lit(None).cast("bigint").alias("last")]
    states = written(models.select(model, *fresh), "breaker-states")
    # Tables with at most a row per model are broadcast if one of them is proven small.
    mark: Mark = F.broadcast if fits_broadcast(states) else lambda table: table

    def under(rows: DataFrame, which: Column) -> DataFrame:
        chosen = states.where(which).select(F.col(model).alias("_m"))
        return rows.join(mark(chosen), rows[model].eqNullSafe(F.col("_m")), "left_semi")

    def kept(rows: DataFrame) -> None:
        rows.write.mode("append").parquet(out)

    called = None
    for wave in range(0 if waves is None else waves + 1):
        at = int(now() * 1_000_000)
        tries = (F.col("state") == OPEN) & (F.lit(at) - F.col("last") > recovery)
        state = F.when(tries, HALF_OPEN).otherwise(F.col("state"))
        states = written(states.withColumn("state", state), "breaker-states")
        rows = todo.where(F.col("_wave") == wave).drop("_wave")
        trying = under(rows, F.col("state") == HALF_OPEN)
        if not states.where(F.col("state") == HALF_OPEN).isEmpty():
            # The first call of each model that may try again; rows without a prompt try nothing.
            first = trying.where("_asked").groupBy(F.col(model).alias("_fm")).agg(F.min("_place").alias("_first"))
            first = mark(written(first, "first-calls"))
            is_first = trying[model].eqNullSafe(F.col("_fm")) & (F.col("_place") == F.col("_first"))
            tried = run_callable(trying.join(first, is_first, "left_semi"), factory, prompt, model, **options)
            kept(tried)
            rows = rows.join(first, rows[model].eqNullSafe(F.col("_fm")) & (rows["_place"] == F.col("_first")), "left_anti")
            states = _after(states, tried, model, at, threshold, mark)
        made = run_callable(under(rows, F.col("state") == CLOSED), factory, prompt, model, **options)
        kept(made)
        kept(_rejected(under(rows, F.col("state") != CLOSED), model))
        states = _after(states, made, model, int(now() * 1_000_000), threshold, mark)
        called = made
    if called is None:
        return run_callable(df.where("false"), factory, prompt, model, **options)
    return df.sparkSession.read.schema(called.schema).parquet(out).drop("_place", "_asked")
