"""Rules over credentials, requests and errors."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from textloom import fixed
from textloom.functions import text as T
from textloom.operators.lookup import lookup_join


def unpivot_keys(df: DataFrame, id_: Sequence[str], keys: Mapping[str, str]) -> DataFrame:
    """One row (provider, api_key) per key that is not null; empty ones stay.

    ``keys`` maps a provider to the column that holds its key.
    """
    renamed = df.select(*id_, *[F.col(c).alias(name) for name, c in keys.items()])
    long = renamed.unpivot(list(id_), list(keys), "provider", "api_key")
    return long.where(F.col("api_key").isNotNull())


def key_errors(keys: Mapping[str, Column], min_length: int = fixed.MIN_KEY_LENGTH) -> Column:
    """All that is wrong with a row of keys, as a list in the order of ``keys``.

    The length is that of the key as given, with its spaces.
    """
    none = F.lit(True)
    found = []
    for name, key in keys.items():
        none = none & key.isNull()
        found.append(
            F.when(T.strip(key) == "", fixed.MSG_KEY_EMPTY.format(name=name)).when(
                F.length(key) < min_length, fixed.MSG_KEY_SHORT.format(name=name)
            )
        )
    return F.array_compact(F.array(F.when(none, fixed.MSG_NO_KEYS), *found))


def error_report(errors: Column, title: str = fixed.MSG_CONFIG_FAILED) -> Column:
    """One message with a line per error; null when there is none."""
    lines = F.array_join(F.transform(errors, lambda e: F.concat(F.lit("- "), e)), "\n")
    return F.when(F.size(errors) > 0, F.concat(F.lit(title + "\n"), lines))


def check_requests(
    df: DataFrame,
    models: DataFrame,
    tasks: Sequence[tuple] = fixed.TASKS,
    model: str = "model",
    task_key: str = "task_key",
    text: str = "text",
) -> DataFrame:
    """Add http_code and error of the first rule a request breaks; 200 and null when none.

    ``models`` has one row per available model key in column ``model_key``.
    """
    table = models.select(F.col("model_key").alias(model)).distinct().withColumn(
        "_known", F.lit(True)
    )
    keys = [t[0] for t in tasks]
    seen = lookup_join(df, table, [model])
    empty = F.lit("")
    error = (
        F.when(F.coalesce(F.col(model), empty) == "", fixed.MSG_MODEL_REQUIRED)
        .when(
            ~F.coalesce(F.col(task_key), empty).isin(keys),
            fixed.MSG_TASK_REQUIRED.format(keys=keys),
        )
        .when(F.coalesce(F.col(text), empty) == "", fixed.MSG_TEXT_REQUIRED)
        .when(F.col("_known").isNull(), T.fill(fixed.MSG_UNKNOWN_MODEL, model=F.col(model)))
    )
    checked = seen.withColumn("error", error).drop("_known")
    return checked.withColumn("http_code", F.when(F.col("error").isNull(), 200).otherwise(400))


def friendly_message(error_type: Column, tag: Column, message: Column) -> Column:
    """What to show for an error.

    Types: processing, model_init, api, quota; anything else is told apart by its message.
    """
    limited = F.contains(message, F.lit("429")) | F.contains(
        F.lower(message), F.lit("rate_limit_exceeded")
    )
    return (
        F.when(error_type == "processing", T.fill(fixed.MSG_PROCESSING, tag=tag, message=message))
        .when(error_type == "model_init", T.fill(fixed.MSG_INIT, tag=tag, message=message))
        .when(error_type == "api", T.fill(fixed.MSG_API, tag=tag, message=message))
        .when(error_type == "quota", fixed.MSG_QUOTA)
        .when(limited, fixed.MSG_RATE_LIMIT)
        .otherwise(T.fill(fixed.MSG_UNEXPECTED, message=message))
    )


def severity(error_type: Column) -> Column:
    """Typed errors are logged as errors, all others as warnings."""
    return F.when(error_type.isin("processing", "model_init", "api"), "error").otherwise("warning")


def log_line(context: Column, message: Column) -> Column:
    named = F.coalesce(context, F.lit("")) != ""
    return F.when(named, F.concat(context, F.lit(": "), message)).otherwise(message)


def console_message(task: Column, message: Column, expected: Column | None = None) -> Column:
    """The error as the console shows it; the web shows ``message`` itself.

    Errors that are not ``expected`` have not been wrapped by the task before.
    """
    wrapped = F.concat(
        F.lit("Error: "),
        friendly_message(F.lit("processing"), task, message),
    )
    if expected is None:
        return wrapped
    other = F.concat(
        F.lit("Unexpected error: "), friendly_message(F.lit("other"), task, message)
    )
    return F.when(expected, wrapped).otherwise(other)
