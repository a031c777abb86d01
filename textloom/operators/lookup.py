"""Joins against lookup tables, safe for large tables and for hot keys."""

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.session import written

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 << 20
HOT_ROWS = 1_000_000
SALTS = 64


def reference_table(spark: SparkSession, rows: Sequence[tuple], schema: dict[str, str]) -> DataFrame:
    """A table typed into the program, such as tasks or templates, as a local relation.

    ``schema`` maps column names to Arrow type names.
    """
    fields = pa.schema([(name, pa.type_for_alias(kind)) for name, kind in schema.items()])
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    arrays = [pa.array(list(c), type=f.type) for c, f in zip(columns, fields)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=fields))


def fits_broadcast(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> bool:
    """Whether ``df`` is proven small, by rows and bytes that its tasks add up by themselves."""
    size = F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("size")
    seen = df.agg(F.count(F.lit(1)).alias("n"), size).first()
    return seen["n"] <= max_rows and (seen["size"] or 0) <= max_bytes


def hot_keys(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame | None:
    """Keys that hold more than ``limit`` rows, or None when there are none.

    One count per key, added up before the shuffle.  There can be no more hot
    keys than rows / ``limit``; they are written down, as callers use them twice.
    """
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    hot = written(hot.select(*keys), "hot-keys")
    return None if hot.isEmpty() else hot


def small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if its size allows it, otherwise left to a shuffle join."""
    return F.broadcast(df) if fits_broadcast(df) else df


def lookup_join(
    df: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    how: str = "left",
    hot_rows: int = HOT_ROWS,
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join rows of any number and any skew to a table that is unique on ``on``.

    A table proven small is broadcast.  Beyond that, the rows of hot keys meet
    a broadcast of just the table rows of those keys, and all other rows go
    through a shuffle join in which no key has more than ``hot_rows`` rows.
    Where even the hot keys' table rows are many, they are copied ``SALTS`` times
    and the rows of each hot key are dealt to as many tasks.
    """
    on = list(on)
    if fits_broadcast(table, max_rows):
        return df.join(F.broadcast(table), on, how)
    known = df.where(" and ".join(f"`{k}` is not null" for k in on))
    hot = hot_keys(known, on, hot_rows)
    if hot is None:
        return df.join(table, on, how)
    hot = small(hot)
    cold_rows = df.join(hot, on, "left_anti").join(table, on, how)
    hot_rows_ = df.join(hot, on, "left_semi")
    hot_table = table.join(hot, on, "left_semi")
    if fits_broadcast(hot_table):
        return cold_rows.unionByName(hot_rows_.join(F.broadcast(hot_table), on, how))
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    dealt = hot_rows_.withColumn("_salt", salt)
    copied = hot_table.withColumn("_salt", every)
    return cold_rows.unionByName(dealt.join(copied, [*on, "_salt"], how).drop("_salt"))
