"""A log of JSON requests answered in bulk."""

from pyspark.sql import DataFrame, functions as F

from textloom.operators.inference import Factory
from textloom.operators.lookup import lookup_join
from textloom.operators.validation import check_requests
from textloom.plans.tasks import execute, prepare
from textloom.sources.listings import task_table
from textloom.sources.sinks import envelope
from textloom.sources.texts import decode_requests

ACCEPTED, REJECTED, FAILED, NOT_READY = 200, 400, 500, 503


def not_ready(df: DataFrame, reason: str) -> DataFrame:
    """The answer to everything while there is no model at all."""
    nothing = F.lit(None).cast("string")
    return df.withColumn("http_code", F.lit(NOT_READY)).withColumn(
        "answer", envelope(nothing, F.lit(reason), nothing, nothing)
    )


def answer(
    df: DataFrame,
    models: DataFrame,
    templates: DataFrame,
    factory: Factory,
    body: str = "body",
    lang: str = "lang",
    **options,
) -> DataFrame:
    """Add http_code and answer to requests (body, and the language of their text).

    A request that breaks a rule is rejected without a call; a call or a
    prompt that fails gives its message.  ``options`` go to ``run_callable``.
    """
    checked = check_requests(decode_requests(df, body), models)
    checked = checked.withColumn("_rejected", F.col("error")).drop("error", "http_code")
    tasks = task_table(df.sparkSession)
    asked = lookup_join(checked, tasks, ["task_key"]).withColumnRenamed("model", "model_key")
    ready = prepare(asked, templates, lang=lang)
    called = F.when(F.col("_rejected").isNull(), F.col("prompt"))
    ready = ready.withColumn("prompt", called).drop("text", body)
    done = execute(ready, factory, **options)
    error = F.coalesce("_rejected", "error")
    code = (
        F.when(F.col("_rejected").isNotNull(), REJECTED)
        .when(error.isNotNull(), FAILED)
        .otherwise(ACCEPTED)
    )
    out = envelope(F.col("result"), error, F.col("model_key"), F.col("task_name"))
    keep = [c for c in df.columns if c != body]
    return done.select(*keep, code.alias("http_code"), out.alias("answer"))
