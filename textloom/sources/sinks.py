"""Results out."""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructType

from textloom.session import written

#: Folders that a table of newest rows is dealt to by key, and most rows of a file in one.
BUCKETS, FILE_ROWS = 256, 5_000_000


def split_status(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that went well, failed rows)."""
    return df.where(F.col("status") == "ok"), df.where(F.col("status") != "ok")


def write_split(df: DataFrame, path: str, format: str = "parquet", mode: str = "error") -> None:
    """One pass that writes good and failed rows to folders status=ok and status=failed."""
    df.write.mode(mode).format(format).partitionBy("status").save(path)


def _free(df: DataFrame, *names: str) -> None:
    clash = sorted({c.lower() for c in df.columns} & set(names))
    if clash:
        raise ValueError(f"folders are named {', '.join(clash)}, so columns must not be")


def split_stream(
    stream: DataFrame, path: str, progress: str, step: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Write good and failed rows of all that the stream has now, each micro-batch once; read them all.

    ``step`` makes rows with a column status, never null, of a micro-batch.  A micro-batch has a folder of
    its own, by the stream's id and its number, which a repeated one writes anew: so
    rows are neither lost nor doubled where a run ends before it has put down how far it came.
    A stream that starts over with other ``progress`` has another id, and overwrites nothing.
    The result has the columns stream, batch and status, by which reads are pruned.
    """
    spark = stream.sparkSession
    shape = spark.createDataFrame([], stream.schema)
    shape = step(shape) if step else shape
    _free(shape, "stream", "batch")
    schema = StructType([*shape.drop("status").schema.fields])
    schema = schema.add("stream", "string").add("batch", "long").add("status", "string")
    # Nothing but a marker: a stream may have no rows at all.
    spark.createDataFrame([], schema).write.mode("append").partitionBy("stream", "batch", "status").parquet(path)

    def put(batch: DataFrame, number: int) -> None:
        rows = step(batch) if step else batch
        own = spark.read.json(f"{progress}/metadata").first()["id"]
        write_split(rows, f"{path}/stream={own}/batch={number}", mode="overwrite")

    running = (
        stream.writeStream.foreachBatch(put)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return spark.read.schema(schema).parquet(path)


def newest_rows(spark: SparkSession, path: str, schema: StructType, buckets: int = BUCKETS) -> DataFrame:
    """The table that ``upsert`` keeps at ``path``, with its bucket; empty where there is none yet."""
    name = f"bucket_of_{buckets}"
    schema = StructType([*schema.fields]).add(name, IntegerType())
    # Nothing but a marker: so that there is something to read.
    spark.createDataFrame([], schema).write.mode("append").partitionBy(name).parquet(path)
    found = spark.read.schema(schema).parquet(path)
    other = [c for c in found.columns if c.startswith("bucket_of_") and c != name]
    if other:
        raise ValueError(f"the table has {other[0]}, not {name}")
    return found


def upsert(
    changes: DataFrame, path: str, key: Sequence[str], seq: Sequence[str], buckets: int = BUCKETS
) -> DataFrame:
    """Bring the table at ``path``, one row per key, up to date; return it, with its bucket.

    Of rows with one key the one with the greatest ``seq`` stays, whichever call brought
    it; nulls are least, and of equally late rows a hash of the whole row decides.  A null key is a
    key.  So a call can be repeated, and calls may come in any order.  Keys are dealt to
    ``buckets`` folders, of which only those that ``changes`` touches are read and written again,
    each by one task; take as many that a bucket suits a task.  One call at a time may write.
    """
    spark, name = changes.sparkSession, f"bucket_of_{buckets}"
    key, columns = list(key), changes.columns
    _free(changes, name)
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
    late = F.struct(*seq, F.xxhash64(*columns))

    def newest(rows: DataFrame) -> DataFrame:
        groups = rows.groupBy(*[F.col(k).alias(f"_key_{k}") for k in key])
        return groups.agg(F.max_by(F.struct(*columns), late).alias("_row")).select("_row.*")

    fresh = written(newest(changes).withColumn(name, bucket), "changes")
    touched = [r[0] for r in fresh.select(name).distinct().collect()]  # at most ``buckets``
    table = newest_rows(spark, path, changes.schema, buckets)
    if touched:
        held = table.where(F.col(name).isin(touched))
        merged = newest(held.unionByName(fresh).select(*columns)).withColumn(name, bucket)
        (
            # Written elsewhere first, as its own files are what it overwrites.
            written(merged, "newest").repartition(name)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .option("maxRecordsPerFile", FILE_ROWS)
            .partitionBy(name)
            .parquet(path)
        )
    return newest_rows(spark, path, changes.schema, buckets)


def envelope(result: Column, error: Column, model: Column, task: Column) -> Column:
    """JSON answer: ok with result, model and task, or not ok with the error."""
    good = F.to_json(
        F.struct(
            F.lit(True).alias("ok"),
            result.alias("result"),
            model.alias("model"),
            task.alias("task"),
        ),
        {"ignoreNullFields": "false"},
    )
    bad = F.to_json(F.struct(F.lit(False).alias("ok"), error.alias("error")))
    return F.when(error.isNull(), good).otherwise(bad)
