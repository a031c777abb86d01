"""Running a stream to the end of what is there now."""

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from textloom.session import new_folder

MICRO_BATCH = str(1 << 30)  # bytes; what a worker can hold, if one key has them all


def files_stream(spark, path: str, schema: StructType, format: str = "parquet", **options):
    """Stream of the files under ``path``.

    A micro-batch, and with it what one key can hold in it, is bounded:
    by ``maxFilesPerTrigger`` or, without that, by ``MICRO_BATCH`` of input.
    """
    if "maxFilesPerTrigger" not in options:
        options.setdefault("maxBytesPerTrigger", MICRO_BATCH)
    return spark.readStream.format(format).schema(schema).options(**options).load(path)


def table_stream(spark, folder: str, name: str, schema: StructType, **options):
    """Stream of a table that is one Parquet file or a folder of them.

    Spark takes the path of a stream for a folder, unless it is a pattern.
    """
    return files_stream(spark, f"{folder}/{name}.parque[t]", schema, **options)


def drain(stream: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Process all available input into a parquet table in the shared folder, and read that.

    Offsets, state and output all lie in the folder, so a restart with the
    same ``folder`` goes on where the last run stopped.
    """
    spark = stream.sparkSession
    folder = folder or new_folder(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/progress")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
