"""Catalogue listings in: fallback lists, credentials and kept snapshots.

Whether a source could be read is a column, because Spark reads lazily and
an error in the middle of a job cannot be caught row by row.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textloom import fixed
from textloom.functions import text as T
from textloom.operators.catalogue import is_text_entry
from textloom.operators.lookup import lookup_join, reference_table

OK, ERROR, NO_KEY, BROKEN = "ok", "error", "no_key", "broken"


def fallback_catalogue(spark: SparkSession) -> DataFrame:
    return reference_table(
        spark,
        fixed.FALLBACK_CATALOGUE,
        {"provider": "string", "id": "string", "display_name": "string"},
    )


def task_table(spark: SparkSession) -> DataFrame:
    return reference_table(
        spark, fixed.TASKS, {"task_key": "string", "task_id": "string", "task_name": "string"}
    )


def with_fallback(
    sources: DataFrame,
    primary: DataFrame,
    fallback: DataFrame,
    on: str = "provider",
    id_: str | None = None,
) -> DataFrame:
    """Rows per source by its status, with column origin.

    ok: what was listed, also when that is nothing.  error or no_key: the
    fallback rows.  broken: nothing.  With ``id_`` the fallback rows pass the
    text filter, too.
    """
    listed = sources.where(F.col("status") == OK).select(on)
    failed = sources.where(F.col("status").isin(ERROR, NO_KEY)).select(on)
    if id_ is not None:
        fallback = fallback.where(is_text_entry(F.col(id_), F.col(on)))
    return (
        lookup_join(primary, listed, [on], "left_semi")
        .withColumn("origin", F.lit("primary"))
        .unionByName(
            lookup_join(fallback, failed, [on], "left_semi").withColumn("origin", F.lit("fallback"))
        )
    )


def kept_snapshots(
    df: DataFrame,
    key: str,
    fetched_at: str,
    payload: Column,
    now: Column,
    ttl_seconds: int = fixed.SNAPSHOT_TTL_SECONDS,
    forced: bool = False,
) -> DataFrame:
    """Latest snapshot per key, of equally late ones the greatest, and whether it is still good.

    Good means not empty and strictly younger than the limit; ``forced``
    refreshes all of them.
    """
    newest = F.max(F.struct(F.col(fetched_at).alias("fetched_at"), payload.alias("payload")))
    latest = df.groupBy(key).agg(newest.alias("_newest")).select(key, "_newest.*")
    age = (
        F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("fetched_at").cast("timestamp"))
    )
    fresh = (age < F.lit(ttl_seconds * 1_000_000)) & (F.coalesce("payload", F.lit("")) != "")
    return latest.withColumn("reuse", F.lit(False) if forced else fresh)


def initialise(
    df: DataFrame,
    credentials: DataFrame,
    provider: str = "provider",
    key: str = "model_key",
    row_error: Column | None = None,
) -> DataFrame:
    """Add status (ok or failed) and error to each entry.

    All entries of a provider without an api_key fail alike; ``row_error``
    fails an entry by itself.
    """
    row_error = F.lit(None).cast("string") if row_error is None else row_error
    keys = credentials.select(F.col("provider").alias(provider), F.col("api_key").alias("_key"))
    label = F.concat(
        F.upper(F.substring(provider, 1, 1)), F.lower(F.substr(F.col(provider), F.lit(2)))
    )
    error = F.when(
        F.coalesce("_key", F.lit("")) == "", T.fill(fixed.MSG_NO_CREDENTIAL, label=label)
    ).when(
        row_error.isNotNull(), T.fill(fixed.MSG_INIT_FAILED, key=F.col(key), error=row_error)
    )
    joined = lookup_join(df, keys, [provider]).withColumn("error", error).drop("_key")
    return joined.withColumn("status", F.when(F.col("error").isNull(), "ok").otherwise("failed"))
