"""Texts typed line by line, as a stream."""

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from textloom import fixed
from textloom.functions import text as T
from textloom.operators.ordered import PAGE_BYTES
from textloom.session import new_folder
from textloom.streaming.run import drain

SLICE = 10_000
# Place and bytes of the first line held, in the whole text; then the lines
_STATE = StructType(
    [
        StructField("place", LongType()),
        StructField("bytes", LongType()),
        StructField("lines", ArrayType(StringType())),
        StructField("done", BooleanType()),
    ]
)


def _ordered(batches: Iterator[pd.DataFrame], places: list[str]) -> Iterator[str]:
    """Lines in order; but for a slice at a time they are held as Arrow text, not as objects."""
    lines, order = [], []
    for b in batches:
        lines.append(pa.array(b["_line"], pa.large_string()))
        order.append(b[places])
    text, rows = pa.chunked_array(lines, pa.large_string()).combine_chunks(), pd.concat(order, ignore_index=True)
    at = rows.sort_values(places, kind="stable").index.to_numpy()
    for start in range(0, len(at), SLICE):
        yield from text.take(pa.array(at[start : start + SLICE])).to_pylist()


def assemble_stream(
    lines: DataFrame,
    session: Sequence[str],
    order: Sequence[str],
    line: str = "line",
    terminator: str = fixed.TERMINATOR,
    page_lines: int = 100_000,
    idle_ms: int | None = None,
    page_bytes: int = PAGE_BYTES,
) -> DataFrame:
    """One text per session once its terminator has come, as the batch form gives it.

    Full pages leave the state as soon as a later line shows that they do not
    end the text.  Lines after the end are dropped, for which an ended session
    leaves a mark of a few bytes.  With ``idle_ms`` a session without a new line for
    that long counts as ended, and the mark of an ended one goes after as long.
    ``open_texts`` has the texts of sessions that have not ended.
    """
    end = terminator.lower()
    schema = _schema(lines, session)
    narrow = lines.select(
        *session, F.struct(*order).alias("_place"), F.col(line).alias("_line")
    ).select(*session, "_line", *[F.col(f"_place.{o}").alias(f"_o{i}") for i, o in enumerate(order)])
    places = [f"_o{i}" for i in range(len(order))]

    def last_text(held: list[str]) -> int:
        """Lines up to the last one that is not blank."""
        n = len(held)
        while n and not held[n - 1].strip():
            n -= 1
        return n

    def step(key: tuple, batches: Iterator[pd.DataFrame], kept: GroupState):
        place, size, held, done = (0, 0, [], False) if not kept.exists else kept.get
        held = list(held)
        out = []

        def paged(text: list[str]) -> Iterator[tuple[int, list[str]]]:
            """The lines held, by page: as many lines, and lines that begin in as many bytes."""
            page, own, at = None, [], size
            for n, one in enumerate(text, place):
                now = n // page_lines + at // page_bytes
                if own and now != page:
                    yield page, own
                    own = []
                page = now
                own.append(one)
                at += len(one.encode()) + 1
            if own:
                yield page, own

        if kept.hasTimedOut:
            if done:
                kept.remove()
                yield pd.DataFrame([], columns=schema.names)
                return
            done_now, new = True, []
        else:
            new, done_now = ([] if done else _ordered(batches, places)), False
        weight = sum(len(t.encode()) + 1 for t in held)
        for text in new:
            if text.strip().lower() == end:
                done_now = True
                break
            if not place and not held:
                text = text.lstrip()
                if not text:
                    continue
            held.append(text)
            weight += len(text.encode()) + 1
            if text.strip() and (len(held) > page_lines or weight > page_bytes):
                *full, (_, rest) = paged(held)
                out += [(*key, page, len(own), "\n".join(own)) for page, own in full]
                gone = held[: len(held) - len(rest)]
                place, size = place + len(gone), size + sum(len(t.encode()) + 1 for t in gone)
                held = rest
                weight = sum(len(t.encode()) + 1 for t in held)
        if done_now:
            *full, last = [*paged(held[: last_text(held)]), None]
            for k, (page, own) in enumerate(full, 1):
                text = "\n".join(own)
                out.append((*key, page, len(own), text.rstrip() if k == len(full) else text))
            held, done = [], True
        kept.update((place, size, held, done))
        if idle_ms:
            kept.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=schema.names)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return narrow.groupBy(*session).applyInPandasWithState(step, schema, _STATE, "append", timeout)


def _schema(lines: DataFrame, session: Sequence[str]) -> StructType:
    return StructType(
        [lines.schema[s] for s in session]
        + [
            StructField("page", LongType()),
            StructField("n_lines", LongType()),
            StructField("text", StringType()),
        ]
    )


def open_texts(
    spark: SparkSession,
    progress: str,
    session: Sequence[str],
    page_lines: int = 100_000,
    page_bytes: int = PAGE_BYTES,
) -> DataFrame:
    """Texts of the sessions that a stopped stream has not seen the end of, from its state.

    At the end of input these are texts like the others.  ``progress`` is the
    stream's checkpoint folder; a stream that goes on from it is not disturbed.
    """
    state = spark.read.format("statestore").load(progress).select("key.*", "value.groupState.*")
    lines = F.transform(
        "lines", lambda t, k: F.when(~T.is_blank(t), k + 1).otherwise(0)
    )
    kept = F.slice("lines", F.lit(1), F.greatest(F.array_max(lines), F.lit(0)))
    held = state.where("not done").where(F.size("lines") > 0).withColumn("lines", kept)
    each = held.where(F.size("lines") > 0).select(
        *session, "place", "bytes", F.size("lines").alias("_n"), F.posexplode("lines").alias("_k", "_line")
    )
    # Lines held are those of one page, and of blank lines after it that turned out to be inner ones.
    own = F.octet_length("_line") + 1
    earlier = Window.partitionBy(*session).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("bytes") + F.coalesce(F.sum(own).over(earlier), F.lit(0))
    page = F.floor((F.col("place") + F.col("_k")) / page_lines) + F.floor(at / page_bytes)
    last = F.col("_k") == F.col("_n") - 1
    text = F.when(last, F.rtrim("_line", F.lit(T.SPACES))).otherwise(F.col("_line"))
    entries = F.sort_array(F.collect_list(F.struct("_k", "_text")))
    return (
        each.withColumn("page", page)
        .withColumn("_text", text)
        .groupBy(*session, "page")
        .agg(
            F.count(F.lit(1)).alias("n_lines"),
            F.array_join(F.transform(entries, lambda e: e["_text"]), "\n").alias("text"),
        )
    )


def assemble_to_the_end(
    lines: DataFrame,
    session: Sequence[str],
    order: Sequence[str],
    line: str = "line",
    terminator: str = fixed.TERMINATOR,
    page_lines: int = 100_000,
    page_bytes: int = PAGE_BYTES,
    folder: str | None = None,
) -> DataFrame:
    """All texts of a stream once all that is there now has been read; the end of input ends a text."""
    spark = lines.sparkSession
    folder = folder or new_folder(spark, "lines")
    stream = assemble_stream(
        lines, session, order, line, terminator, page_lines, page_bytes=page_bytes
    )
    ended = drain(stream, "lines", folder)
    rest = open_texts(spark, f"{folder}/progress", session, page_lines, page_bytes)
    return ended.unionByName(rest)
