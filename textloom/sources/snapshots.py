"""Tables fetched once and used again by later jobs, until they are too old.

Each fetch is a version: a folder of its own that is never written again, and a
row in a table of markers that is written last.  A job that finds a marker finds a
whole version, whoever else reads or fetches meanwhile; a fetch that failed
halfway has no marker and is never seen.
"""

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom import fixed

_MARKERS = "version string, fetched_at double, n bigint"


def versions(spark: SparkSession, folder: str) -> DataFrame:
    """(version, fetched_at, n) of all whole versions below ``folder``."""
    path = f"{folder}/markers"
    # An empty first marker, so that there is something to read; any number of jobs may add one.
    spark.createDataFrame([], _MARKERS).write.mode("append").parquet(path)
    return spark.read.schema(_MARKERS).parquet(path)


def fetched(
    spark: SparkSession,
    folder: str,
    load: Callable[[], DataFrame],
    ttl_seconds: float = fixed.SNAPSHOT_TTL_SECONDS,
    force: bool = False,
    now: Callable[[], float] = time.time,
) -> DataFrame:
    """The newest version below ``folder`` if it has rows and is younger than ``ttl_seconds``, else what ``load`` gives.

    Exactly as old as the limit is too old.  ``force`` fetches anyway.  A new fetch is kept as
    the newest version; one without rows is returned, but never used again, and an older one
    that has rows isn't either.  ``folder`` is one that all executors share.  Where two jobs
    fetch at once both versions are whole, and the later one counts.
    """
    if not force:
        newest = versions(spark, folder).agg(F.max(F.struct("fetched_at", "version", "n")).alias("v")).first()["v"]
        if newest and newest["n"] and now() - newest["fetched_at"] < ttl_seconds:
            return spark.read.parquet(f"{folder}/{newest['version']}")
    version = f"version-{uuid.uuid4().hex}"
    at = float(now())
    fresh = load()
    fresh.write.parquet(f"{folder}/{version}")
    kept = spark.read.schema(fresh.schema).parquet(f"{folder}/{version}")
    marker = [(version, at, kept.count())]
    spark.createDataFrame(marker, _MARKERS).coalesce(1).write.mode("append").parquet(f"{folder}/markers")
    return kept
