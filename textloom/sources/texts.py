"""Texts and requests in."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from textloom.functions import text as T

REQUEST_FIELDS = ("model", "task_key", "text")
STRICT = {"mode": "PERMISSIVE", "allowSingleQuotes": "false"}


def non_blank(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows that hold a text, with the spaces around it gone."""
    clean = df.withColumn(text, T.strip(F.col(text)))
    return clean.where(F.col(text) != "")


def read_texts(
    spark: SparkSession, path: str, format: str = "parquet", text: str = "text", **options: str
) -> DataFrame:
    """Non-blank texts from parquet, json, csv, orc, or text files.

    Format ``text`` reads one text per line, and with ``wholetext="true"``
    one per file.
    """
    df = spark.read.format(format).options(**options).load(path)
    if format == "text":
        df = df.withColumnRenamed("value", text)
    return non_blank(df, text)


def is_json(body: Column) -> Column:
    """Whether a text is one JSON value and nothing after it.

    The parser stops where a value ends, so the text is read as the first of
    two items of a list, of which the second is known.
    """
    mark = F.md5(body)
    listed = F.concat(F.lit("["), body, F.lit(',"'), mark, F.lit('"]'))
    items = F.from_json(listed, "array<string>", STRICT)
    return F.coalesce((F.size(items) == 2) & (F.get(items, 1) == mark), F.lit(False))


def decode_requests(
    df: DataFrame, body: str = "body", fields: Sequence[str] = REQUEST_FIELDS
) -> DataFrame:
    """Fields of a JSON body, stripped; what is not one JSON value, and missing fields, give empty strings.

    So do null fields, and all fields of a body that is no object.  A field that is no
    text gives its value as JSON: 1, true, [1,2].
    """
    schema = StructType([StructField(f, StringType()) for f in fields])
    request = F.from_json(F.col(body), schema, STRICT)
    parsed = df.withColumn("_request", F.when(is_json(F.col(body)), request))
    clean = {f: T.strip(F.coalesce(F.col(f"_request.{f}"), F.lit(""))) for f in fields}
    return parsed.withColumns(clean).drop("_request")


def text_lines(df: DataFrame, text: str = "text", *keep: str | Column) -> DataFrame:
    """One row per line of each text: the kept columns, line_no and line."""
    return df.select(*keep, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))


def spread_out(df: DataFrame) -> DataFrame:
    """``df`` over all cores where it comes in fewer partitions than there are; larger tables stay as read.

    A small file may be one piece however many tasks read it.  Worth its shuffle only
    where much is done with each text.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
