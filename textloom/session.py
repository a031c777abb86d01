"""Session settings and the shared folder for cut lineage."""

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | int = 8, app: str = "textloom", memory: str = "8g") -> SparkSession:
    """Session for tests and the bench; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    A session on one machine without that setting gets a folder of its own, which
    goes when the program ends; on a cluster of any kind the setting is needed.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if not named:
        named = context.getCheckpointDir()
    if not named:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="textloom-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def new_folder(spark: SparkSession, name: str) -> str:
    """A path not used before, inside the shared folder."""
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, name: str = "kept") -> DataFrame:
    """Write ``df`` as parquet to the shared folder and go on from there.

    Survives lost executors, freezes values such as row positions that a second
    evaluation could number differently, and keeps a caller's function from
    being run again by a second reader.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

