"""Default prompt templates.  The wording is free; callers pass their own table."""

from pyspark.sql import DataFrame, SparkSession

from textloom.operators.lookup import reference_table

HOLE = "{user_text}"

TEMPLATES = [
    (
        "refine",
        "Rewrite the text below so that it reads clearly and politely. "
        "Keep every fact. Answer with the new text only.\n\n{user_text}\n\nNew text:",
    ),
    (
        "refine_presentation",
        "Turn the text below into short spoken points, one per line, "
        "without adding facts.\n\n{user_text}\n\nPoints:",
    ),
    ("en_to_zh", "Write the text below in Chinese.\n\n{user_text}\n\nIn Chinese:"),
    ("zh_to_en", "Write the text below in English.\n\n{user_text}\n\nIn English:"),
]


def template_table(spark: SparkSession, rows=None) -> DataFrame:
    return reference_table(
        spark, TEMPLATES if rows is None else rows, {"task_id": "string", "template": "string"}
    )
