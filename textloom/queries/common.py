"""What the queries share: table loading, and SQL for the check side."""

from pyspark.sql import DataFrame, SparkSession

from textloom.functions.text import SPACE_CLASS


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE_CLASS}]+|[{SPACE_CLASS}]+$', '', 'g')"


def sql_tokens(x: str) -> str:
    """Distinct words; a blank text has none."""
    return (
        f"list_filter(list_distinct(regexp_split_to_array({sql_strip(f'lower({x})')}, "
        f"'[{SPACE_CLASS}]+')), lambda w: w <> '')"
    )


def sql_natural(x: str) -> str:
    """List of (text, number length, number) per run, to sort by."""
    runs = f"list_filter(regexp_extract_all(lower({x}), '[^0-9]*[0-9]*'), lambda r: r <> '')"
    letters = "regexp_replace(r, '[0-9]+$', '')"
    digits = "regexp_extract(r, '[0-9]+$')"
    number = (
        f"CASE WHEN {digits} = '' THEN '' WHEN ltrim({digits}, '0') = '' THEN '0' "
        f"ELSE ltrim({digits}, '0') END"
    )
    return (
        f"list_transform({runs}, lambda r: "
        f"{{'t': {letters}, 's': length({number}), 'n': {number}}})"
    )


def sql_str(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(sql_str(v) for v in values) + "]"
