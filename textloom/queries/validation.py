"""Queries that check requests and credentials and sort errors out."""

from pyspark.sql import functions as F

from textloom.operators.ordered import pages
from textloom.operators.validation import (
    check_requests,
    console_message,
    error_report,
    friendly_message,
    key_errors,
    log_line,
    severity,
    unpivot_keys,
)
from textloom.queries.common import table
from textloom.sources.texts import decode_requests


def _keys():
    """Three columns of customer as keys, with nulls and blanks among them."""
    return {
        "segment": F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")),
        "name": F.when(F.col("c_nationkey") > 5, F.col("c_name")),
        "balance": F.when(F.col("c_acctbal") < 0, "   ").when(F.col("c_acctbal") > 5000, " rich "),
    }


def rule_report(spark, folder):
    customer = table(spark, folder, "customer")
    return customer.select("c_custkey", F.explode(key_errors(_keys())).alias("error"))


def config_report(spark, folder):
    report = error_report(key_errors(_keys()))
    return table(spark, folder, "customer").select(
        "c_custkey", report.isNull().alias("is_valid"), report.alias("report")
    )


def unpivot_keys_(spark, folder):
    part = table(spark, folder, "part").withColumn(
        "p_name", F.when(F.col("p_size") < 10, "").when(F.col("p_size") < 40, F.col("p_name"))
    )
    return unpivot_keys(
        part, ["p_partkey"], {"brand": "p_brand", "type": "p_type", "name": "p_name"}
    )


def request_check(spark, folder):
    k = F.get_json_object("props", "$.k").cast("int")
    task = (
        F.when(F.col("event_type") == "error", "9")
        .when(F.col("event_type") == "view", " 2 ")
        .otherwise("1")
    )
    body = F.to_json(
        F.struct(
            F.when(k > 2, F.concat(F.lit(" user-"), F.col("user_id").cast("string"))).alias("model"),
            task.alias("task_key"),
            F.when(k < 10, " \n ").otherwise(F.col("props")).alias("text"),
        )
    )
    body = F.when(F.col("value") > 1, body).otherwise(F.substring(body, 1, 9))
    events = table(spark, folder, "events").select("event_id", body.alias("body"))
    customer = table(spark, folder, "customer").where("c_acctbal > 0")
    models = customer.select(
        F.concat(F.lit("user-"), F.col("c_custkey").cast("string")).alias("model_key")
    )
    return check_requests(decode_requests(events), models).select(
        "event_id", F.col("http_code").cast("bigint").alias("http_code"), "error"
    )


def _errors(spark, folder):
    """Error events as errors of all types; the task is the user."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = (
        F.when(k < 10, "processing").when(k < 20, "model_init").when(k < 25, "api")
        .when(k < 27, "quota").otherwise("other")
    )
    message = F.when(k == 50, "Rate_Limit_Exceeded").otherwise(
        F.concat(F.lit("code "), (k + 400).cast("string"))
    )
    return (
        table(spark, folder, "events")
        .where("event_type = 'error'")
        .select(
            "event_id",
            "ts",
            kind.alias("kind"),
            F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("tag"),
            message.alias("message"),
        )
    )


def error_triage(spark, folder):
    kind, tag, message = F.col("kind"), F.col("tag"), F.col("message")
    friendly = friendly_message(kind, tag, message)
    context = F.when(kind != "api", F.concat(F.lit("Task "), tag)).otherwise("")
    return _errors(spark, folder).select(
        "event_id",
        friendly.alias("friendly"),
        severity(kind).alias("severity"),
        log_line(context, message).alias("log_line"),
        console_message(tag, friendly, kind != "quota").alias("console"),
    )


def error_digest(spark, folder):
    line = F.concat(F.lit("- "), F.col("tag"), F.lit(": "), F.col("message"))
    digest = pages(_errors(spark, folder), [], ["ts", "event_id"], line, page_rows=100)
    return digest.select("page", "n_items", F.md5("items").alias("h"))


_KEYS_SQL = """SELECT c_custkey,
    CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS segment,
    CASE WHEN c_nationkey > 5 THEN c_name END AS name,
    CASE WHEN c_acctbal < 0 THEN '   ' WHEN c_acctbal > 5000 THEN ' rich ' END AS balance
  FROM customer"""
_KEY_ERRORS_SQL = "list_filter([CASE WHEN segment IS NULL AND name IS NULL AND balance IS NULL THEN 'At least one API key must be provided' END, " + ", ".join(
    f"""CASE WHEN trim({k}) = '' THEN '{k} API key is empty'
        WHEN length({k}) < 10 THEN '{k} API key appears to be too short' END"""
    for k in ("segment", "name", "balance")
) + "], lambda e: e IS NOT NULL)"
_ERRORS_SQL = """SELECT event_id, ts, k, 'u' || user_id AS tag,
    CASE WHEN k < 10 THEN 'processing' WHEN k < 20 THEN 'model_init' WHEN k < 25 THEN 'api'
      WHEN k < 27 THEN 'quota' ELSE 'other' END AS kind,
    CASE WHEN k = 50 THEN 'Rate_Limit_Exceeded' ELSE 'code ' || (k + 400) END AS message
  FROM (SELECT *, (props->>'$.k')::INT AS k FROM events WHERE event_type = 'error')"""

QUERIES = {
    "rule_report": (
        rule_report,
        f"SELECT c_custkey, unnest({_KEY_ERRORS_SQL}) AS error FROM ({_KEYS_SQL})",
    ),
    "config_report": (
        config_report,
        f"""SELECT c_custkey, len(e) = 0 AS is_valid, CASE WHEN len(e) > 0 THEN
          'Configuration validation failed:' || chr(10) || array_to_string(
            list_transform(e, lambda x: '- ' || x), chr(10)) END AS report
        FROM (SELECT c_custkey, {_KEY_ERRORS_SQL} AS e FROM ({_KEYS_SQL}))""",
    ),
    "unpivot_keys": (
        unpivot_keys_,
        """SELECT p_partkey, 'brand' AS provider, p_brand AS api_key FROM part
        UNION ALL SELECT p_partkey, 'type', p_type FROM part
        UNION ALL SELECT p_partkey, 'name', CASE WHEN p_size < 10 THEN '' ELSE p_name END
        FROM part WHERE p_size < 40""",
    ),
    "request_check": (
        request_check,
        """WITH e AS (SELECT event_id, value, event_type, user_id, (props->>'$.k')::INT AS k FROM events),
        m AS (SELECT 'user-' || c_custkey AS model FROM customer WHERE c_acctbal > 0),
        r AS (SELECT event_id, k,
            CASE WHEN value > 1 AND k > 2 THEN 'user-' || user_id ELSE '' END AS model,
            event_type = 'error' AS bad_task FROM e),
        c AS (SELECT event_id, CASE WHEN r.model = '' THEN 'model is required'
            WHEN bad_task THEN 'task_key must be one of [''1'', ''2'', ''3'']'
            WHEN k < 10 THEN 'text is required'
            WHEN m.model IS NULL THEN 'Unknown model: ' || r.model END AS error
          FROM r LEFT JOIN m ON m.model = r.model)
        SELECT event_id, CASE WHEN error IS NULL THEN 200 ELSE 400 END::BIGINT AS http_code, error
        FROM c""",
    ),
    "error_triage": (
        error_triage,
        f"""WITH e AS ({_ERRORS_SQL}),
        f AS (SELECT *, CASE kind
            WHEN 'processing' THEN 'Processing error in task ''' || tag || ''': ' || message
            WHEN 'model_init' THEN 'Failed to initialize model ''' || tag || ''': ' || message
            WHEN 'api' THEN 'API error with ' || tag || ': ' || message
            WHEN 'quota' THEN 'Google API quota exceeded. Please wait and try again, or select a different model.'
            ELSE CASE WHEN contains(message, '429') OR contains(lower(message), 'rate_limit_exceeded')
              THEN 'API rate limit or quota exceeded. Please wait and try again, or select a different model.'
              ELSE 'An unexpected error occurred: ' || message END END AS friendly FROM e)
        SELECT event_id, friendly,
          CASE WHEN kind IN ('processing', 'model_init', 'api') THEN 'error' ELSE 'warning' END AS severity,
          CASE WHEN kind <> 'api' THEN 'Task ' || tag || ': ' || message ELSE message END AS log_line,
          CASE WHEN kind <> 'quota'
            THEN 'Error: Processing error in task ''' || tag || ''': ' || friendly
            ELSE 'Unexpected error: ' || CASE WHEN contains(friendly, '429')
              OR contains(lower(friendly), 'rate_limit_exceeded')
              THEN 'API rate limit or quota exceeded. Please wait and try again, or select a different model.'
              ELSE 'An unexpected error occurred: ' || friendly END END AS console
        FROM f""",
    ),
    "error_digest": (
        error_digest,
        f"""WITH e AS (SELECT '- ' || tag || ': ' || message AS line,
            row_number() OVER (ORDER BY ts, event_id) AS rn FROM ({_ERRORS_SQL}))
        SELECT ((rn - 1) // 100)::BIGINT AS page, count(*) AS n_items,
          md5(string_agg(line, chr(10) ORDER BY rn)) AS h FROM e GROUP BY 1""",
    ),
}
