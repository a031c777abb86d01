"""Small helpers that the operators of this package share."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.session import new_folder

#: Texts taken out of Arrow at a time, so that a batch is never copied whole.
SLICE = 128


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written once to the shared folder and read again: cuts lineage, and later reads are cheap."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def as_bytes(column: str | Column) -> Column:
    """Text as UTF-8, empty for null."""
    text = F.col(column) if isinstance(column, str) else column
    return F.coalesce(text.cast("binary"), F.lit(b""))


def pieces(array: pa.Array) -> Iterator[list]:
    """The values of an Arrow array, a few at a time."""
    for start in range(0, len(array), SLICE):
        yield array.slice(start, SLICE).to_pylist()


def values(array: pa.Array) -> Iterator:
    for part in pieces(array):
        yield from part


def sampled(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """About ``rows`` rows of ``df`` (all, if it has no more), the same ones at each run.

    Rows are taken by a hash of ``key``, so nothing is sorted or gathered.
    """
    total = df.count()
    if total <= rows:
        return df
    span = 1 << 40
    return df.filter(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(span)) < int(span * rows / total))
