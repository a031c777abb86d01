"""From requests to prompts, and from prompts to results."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from textloom import fixed
from textloom.functions import text as T
from textloom.operators.inference import API, REJECTED, Factory, run_callable
from textloom.operators.lookup import lookup_join
from textloom.operators.routing import add_template, direction
from textloom.operators.validation import console_message, friendly_message
from textloom.operators.waves import run_in_waves


def prepare(
    df: DataFrame,
    templates: DataFrame,
    models: DataFrame | None = None,
    model: str = "model_key",
    task: str = "task_id",
    text: str = "text",
    lang: str = "lang",
) -> DataFrame:
    """Add prompt, or error when model, task or template are missing, and error_task.

    What was not selected at all is noticed first, of a task called unknown; then
    a model that does not exist, then a template.  For auto_translate the language
    picks the template: ``prompt_task`` says whose template was taken.
    """
    rows = df
    empty = F.lit("")
    unselected = F.when(F.coalesce(F.col(model), empty) == "", fixed.MSG_NO_MODEL).when(
        F.coalesce(F.col(task), empty) == "", fixed.MSG_NO_TASK
    )
    missing_model = F.lit(None).cast("string")
    if models is not None:
        table = models.select(F.col("model_key").alias(model)).distinct()
        rows = lookup_join(rows, table.withColumn("_known", F.lit(True)), [model])
        missing_model = F.when(
            F.col("_known").isNull(),
            T.fill(fixed.MSG_MODEL_NOT_FOUND, model=F.col(model)),
        )
    asked = rows.withColumn("_asked", F.col(task))
    routed = direction(asked.drop(task), F.col(lang)).withColumnRenamed("task_id", "_routed")
    routed = routed.withColumn(
        "prompt_task",
        F.when(F.col("_asked") == fixed.AUTO_TRANSLATE, F.col("_routed")).otherwise(F.col("_asked")),
    ).withColumnRenamed("_asked", task)
    found = add_template(routed, templates, "prompt_task")
    no_prompt = F.when(
        F.coalesce("template", empty) == "",
        T.fill(fixed.MSG_PROMPT_NOT_FOUND, task=F.col(task)),
    )
    found = found.withColumn("error", F.coalesce(unselected, missing_model, no_prompt))
    found = found.withColumn(
        "error_task", F.when(unselected.isNotNull(), fixed.UNKNOWN_TASK).otherwise(F.col(task))
    )
    prompt = F.when(F.col("error").isNull(), T.render(F.col("template"), F.col(text)))
    return found.withColumn("prompt", prompt).drop(
        "template", "_known", "_routed", "source_language", "target_language"
    )


def execute(
    prepared: DataFrame,
    factory: Factory,
    model: str = "model_key",
    guard: bool = True,
    order: Sequence[str] = (),
    **options,
) -> DataFrame:
    """Run the prompts.  Adds result, is_error, error, error_type and the console's message.

    Failures are rows, never the end of the job: a failed call gets the
    friendly message of its error's type.  Calls go through a breaker per model,
    kept by each task for itself; ``guard=False`` leaves it out.  With ``order``, all tasks
    share it, moved on between waves of calls (``operators.waves``).  All columns of
    ``prepared`` pass through the Python workers, so drop the text first if the
    prompt is enough.
    """
    if order:
        ran = run_in_waves(prepared, factory, model, order, **options)
    else:
        ran = run_callable(prepared, factory, "prompt", model, guard=guard, **options)
    kind = F.when(F.col("error_type") == REJECTED, API).otherwise(F.col("error_type"))
    called = F.when(
        F.col("call_error").isNotNull(),
        friendly_message(kind, F.col(model), F.col("call_error")),
    )
    done = ran.withColumn("error", F.coalesce("error", called))
    return done.withColumn("is_error", F.col("error").isNotNull()).withColumn(
        "message",
        F.when(F.col("is_error"), console_message(F.col("error_task"), F.col("error"))).otherwise(
            F.col("result")
        ),
    ).drop("error_task")
