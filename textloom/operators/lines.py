"""Texts typed line by line, up to a terminator."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from textloom import fixed
from textloom.functions import text as T
from textloom.operators.lookup import lookup_join
from textloom.operators.ordered import CHUNK_ROWS, PAGE_BYTES, pages
from textloom.session import written


def is_terminator(line: Column, terminator: str = fixed.TERMINATOR) -> Column:
    return T.strip(F.lower(line)) == terminator.lower()


def assemble_lines(
    df: DataFrame,
    session: Sequence[str],
    order: Sequence[str],
    line: str = "line",
    terminator: str = fixed.TERMINATOR,
    page_lines: int = 100_000,
    chunk_rows: int = CHUNK_ROWS,
    page_bytes: int = PAGE_BYTES,
) -> DataFrame:
    """The text of each session: its lines before the terminator, stripped as a whole.

    A text of more than ``page_lines`` lines or ``page_bytes`` bytes comes in
    several pages that are the whole text when joined with a newline.  A null
    session is a session, too; sessions without any text are left out.  First and
    last lines are found by partial aggregates, so a session of any size is never
    held by one task; they are written to the shared folder, as each is looked at
    twice.
    """
    session = list(session)
    # A struct is never null itself, so rows of a null session meet their own
    rows = df.withColumn("_place", F.struct(*order)).withColumn("_session", F.struct(*session))
    ends = written(
        rows.where(is_terminator(F.col(line), terminator))
        .groupBy("_session")
        .agg(F.min("_place").alias("_end")),
        "line-ends",
    )
    kept = lookup_join(rows, ends, ["_session"]).where(
        F.col("_end").isNull() | (F.col("_place") < F.col("_end"))
    )
    edges = written(
        kept.where(~T.is_blank(F.col(line)))
        .groupBy("_session")
        .agg(F.min("_place").alias("_first"), F.max("_place").alias("_last")),
        "line-edges",
    )
    inner = lookup_join(kept, edges, ["_session"], "inner").where(
        F.col("_place").between(F.col("_first"), F.col("_last"))
    )
    spaces = F.lit(T.SPACES)
    item = F.when(F.col("_place") == F.col("_first"), F.ltrim(line, spaces)).otherwise(F.col(line))
    item = F.when(F.col("_place") == F.col("_last"), F.rtrim(item, spaces)).otherwise(item)
    out = pages(inner, session, ["_place"], item, page_lines, "\n", chunk_rows, page_bytes)
    return out.withColumnsRenamed({"items": "text", "n_items": "n_lines"})
