"""What one turn of a session takes over from the turns before it."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from textloom.operators.ordered import CHUNK_ROWS, Ordered


def _answer(goes_on: Column | None) -> Column:
    """Whether a session goes on after a turn: so it does where nobody was asked."""
    return F.lit(True) if goes_on is None else F.coalesce(goes_on, F.lit(True))


def previous_results(
    df: DataFrame,
    session: Sequence[str],
    order: Sequence[str],
    task: Column,
    result: Column,
    is_error: Column,
    processed: Column | None = None,
    goes_on: Column | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add the result each turn may reuse.

    previous_result is null after an error, and after a turn where ``goes_on``,
    the answer given after it, is false: all that was stored is forgotten then.
    can_use_previous also asks for the same task as before, and offer_previous
    for a result that is not empty.  A turn that is not ``processed``, such as
    one with a blank text, leaves what is stored as it is, unless it is forgotten.
    No answer (null) counts as going on.
    """
    goes_on = _answer(goes_on)
    good = goes_on & ~is_error
    state = F.struct(
        F.when(good, result).alias("result"),
        F.when(good, task).alias("task"),
        (goes_on & is_error).alias("is_error"),
    )
    stores = None if processed is None else processed | ~goes_on
    turns = Ordered(df, session, order, chunk_rows).previous(state, "_before", stores).frame()
    before = F.col("_before")
    has_result = F.coalesce(before["result"].isNotNull(), F.lit(False))
    same_task = F.coalesce(before["task"] == task, F.lit(False))
    return (
        turns.withColumn("previous_result", before["result"])
        .withColumn("can_use_previous", has_result & same_task)
        .withColumn("offer_previous", F.col("can_use_previous") & (before["result"] != ""))
        .withColumn("after_error", F.coalesce(before["is_error"], F.lit(False)))
        .withColumn("can_continue", task.isNotNull() & result.isNotNull() & ~is_error)
        .drop("_before")
    )


def refinement_chains(
    df: DataFrame,
    session: Sequence[str],
    order: Sequence[str],
    task: Column,
    result: Column,
    is_error: Column,
    goes_on: Column | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add chain_no: turns stay in a chain while each reuses the result before it.

    A chain ends with an error, with another task, and where ``goes_on``, the
    answer given after a turn, is false.  No answer (null) counts as going on, as
    in ``previous_results``.
    """
    goes_on = _answer(goes_on)
    state = F.struct(task.alias("task"), (goes_on & result.isNotNull() & ~is_error).alias("goes_on"))
    ordered = Ordered(df, session, order, chunk_rows).previous(state, "_before")
    before = F.col("_before")
    joined = F.coalesce(before["goes_on"] & (before["task"] == task), F.lit(False))
    ordered.running_sum(F.when(joined, 0).otherwise(1).cast("bigint"), "chain_no")
    return ordered.frame().drop("_before")


def chain_summary(
    df: DataFrame, session: Sequence[str], order: Column, text: Column
) -> DataFrame:
    """Length, first and last text of each chain, added up before the shuffle."""
    return df.groupBy(*session, "chain_no").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.min_by(text, order).alias("first_text"),
        F.max_by(text, order).alias("last_text"),
    )
