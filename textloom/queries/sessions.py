"""Queries over sessions, lines and call logs."""

from pyspark.sql import functions as F

from textloom.operators.breaker import replay
from textloom.operators.lines import assemble_lines
from textloom.operators.sessions import chain_summary, previous_results, refinement_chains
from textloom.queries.common import sql_strip, table
from textloom.sources.texts import text_lines
from textloom.session import new_folder, written
from textloom.streaming.breaker import LATE, replay_stream, replay_to_the_end
from textloom.streaming.lines import assemble_to_the_end
from textloom.streaming.run import drain, files_stream, table_stream

DAY = 86_400.0
END = "at"


def _turns(spark, folder):
    """Turns with a task by length; a very short text stands for an error."""
    n = F.length("text")
    return table(spark, folder, "conversations").select(
        "conv_id",
        "turn",
        F.when(n < 300, "short").otherwise("long").alias("task"),
        F.when(n >= 60, F.md5("text")).alias("result"),
        (n < 60).alias("is_error"),
        (F.col("role") != "system").alias("processed"),
        (n % 7 != 0).alias("goes_on"),
    )


def prev_reuse(spark, folder):
    return previous_results(
        _turns(spark, folder),
        ["conv_id"],
        ["turn"],
        F.col("task"),
        F.col("result"),
        F.col("is_error"),
        F.col("processed"),
        F.col("goes_on"),
    ).select(
        "conv_id",
        "turn",
        "previous_result",
        "can_use_previous",
        "offer_previous",
        "after_error",
        "can_continue",
    )


def refine_chains(spark, folder):
    chains = refinement_chains(
        _turns(spark, folder),
        ["conv_id"],
        ["turn"],
        F.col("task"),
        F.col("result"),
        F.col("is_error"),
        F.col("goes_on"),
    )
    return chain_summary(
        chains, ["conv_id"], F.col("turn"), F.coalesce("result", F.lit("-"))
    )


def breaker_replay(spark, folder):
    calls = table(spark, folder, "events").select(
        "event_id", "user_id", "ts", (F.col("event_type") == "error").alias("failed")
    )
    return replay(
        calls, ["user_id"], ["ts", "event_id"], "ts", "failed", recovery_seconds=DAY
    ).drop("ts", "failed")


def breaker_by_type(spark, folder):
    """Few keys with very many calls each, so that every key is replayed in chunks."""
    calls = table(spark, folder, "events").select(
        "event_id", "event_type", "ts", (F.col("value") > 20).alias("failed")
    )
    return replay(
        calls,
        ["event_type"],
        ["ts", "event_id"],
        "ts",
        "failed",
        recovery_seconds=3600.0,
        chunk_rows=500,
    ).drop("ts", "failed")


def breaker_stream(spark, folder):
    schema = table(spark, folder, "events").schema
    events = table_stream(spark, folder, "events", schema)
    calls = events.withColumn("failed", F.col("event_type") == "error")
    stream = replay_stream(
        calls, ["user_id"], "event_id", "ts", "failed", recovery_seconds=DAY
    )
    return drain(stream, "breaker-stream")


#: Calls come in windows of so many days, up to 23 hours after their time.
_WINDOW_DAYS = 8
#: States that the users' breakers are kept in.
_KEY_GROUPS = 1024


def _arriving(spark, folder, delay_seconds):
    """Calls of the events, arriving window by window and there in any order, replayed by their times."""
    events = table(spark, folder, "events")
    late_hours = F.col("event_id") * 7919 % 24
    micros = F.unix_micros(F.col("ts").cast("timestamp")) + late_hours * 3_600_000_000
    window = F.floor(micros / (_WINDOW_DAYS * DAY * 1_000_000))
    calls = written(
        events.select("event_id", "user_id", "ts", (F.col("event_type") == "error").alias("failed"))
        .withColumn("window", window),
        "arrivals",
    )
    windows = sorted(r[0] for r in calls.select("window").distinct().collect())
    path = new_folder(spark, "arriving")
    progress = new_folder(spark, "ordered-calls")
    for window in windows:
        some = calls.where(F.col("window") == window)
        some.repartition(4, F.xxhash64("event_id")).write.mode("append").parquet(path)
        stream = files_stream(spark, path, calls.schema)
        options = {"recovery_seconds": DAY, "folder": progress, "key_groups": _KEY_GROUPS}
        found = replay_to_the_end(
            stream, ["user_id"], "event_id", "ts", "failed", delay_seconds, **options
        )
    return found


def breaker_reordered(spark, folder):
    """Calls that come up to 23 hours late, with a day to wait for them: as if all came in order."""
    return _arriving(spark, folder, DAY)


def breaker_late(spark, folder):
    """Calls that come up to 23 hours late, with six hours to wait: how many of a user's are too late."""
    found = _arriving(spark, folder, 6 * 3600)
    too_late = F.count(F.when(F.col("outcome") == LATE, 1)).alias("n_late")
    return found.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_calls"), too_late)


def _words_as_lines(turns):
    """Conversations typed one word per line, so that the word ``END`` ends some of them."""
    words = turns.withColumn("text", F.replace("text", F.lit(" "), F.lit("\n")))
    return text_lines(words, "text", "conv_id", "turn")


def line_assembly(spark, folder):
    lines = _words_as_lines(table(spark, folder, "conversations"))
    texts = assemble_lines(lines, ["conv_id"], ["turn", "line_no"], "line", END, page_lines=25)
    return texts.select("conv_id", "page", "n_lines", F.md5("text").alias("h"))


def line_stream(spark, folder):
    schema = table(spark, folder, "conversations").schema
    turns = table_stream(spark, folder, "conversations", schema)
    lines = _words_as_lines(turns)
    texts = assemble_to_the_end(lines, ["conv_id"], ["turn", "line_no"], "line", END, page_lines=25)
    return texts.select("conv_id", "page", "n_lines", F.md5("text").alias("h"))


_TURNS_SQL = """SELECT conv_id, turn, CASE WHEN length(text) < 300 THEN 'short' ELSE 'long' END AS task,
    CASE WHEN length(text) >= 60 THEN md5(text) END AS result, length(text) < 60 AS is_error,
    role <> 'system' AS processed, length(text) % 7 <> 0 AS goes_on FROM conversations"""



def _breaker_sql(key: str, failed: str, recovery_us: int) -> str:
    return f"""WITH RECURSIVE
  c AS (SELECT event_id, {key}, epoch_us(ts) AS t, {failed} AS failed,
    row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS rn FROM events),
  s AS (
    SELECT {key}, 0::BIGINT AS rn, 0::BIGINT AS event_id, 'closed' AS admitted_as,
      '' AS outcome, 'closed' AS state_after, 0::BIGINT AS failures, 0::BIGINT AS last
    FROM (SELECT DISTINCT {key} FROM events)
    UNION ALL
    SELECT {key}, rn, event_id, admitted_as, outcome,
      CASE WHEN outcome = 'rejected' THEN 'open'
        WHEN outcome = 'success' THEN 'closed'
        WHEN before + 1 >= 3 THEN 'open' ELSE admitted_as END,
      CASE WHEN outcome = 'failure' THEN before + 1
        WHEN outcome = 'success' AND admitted_as = 'half-open' THEN 0 ELSE before END,
      CASE WHEN outcome = 'failure' THEN t ELSE last END
    FROM (SELECT *, CASE WHEN admitted_as = 'open' THEN 'rejected'
            WHEN failed THEN 'failure' ELSE 'success' END AS outcome
          FROM (SELECT c.{key}, c.rn, c.event_id, c.t, c.failed, s.failures AS before, s.last,
                  CASE WHEN s.state_after = 'open' AND c.t - s.last > {recovery_us} THEN 'half-open'
                    ELSE s.state_after END AS admitted_as
                FROM s JOIN c ON c.{key} = s.{key} AND c.rn = s.rn + 1)))
  SELECT event_id, {key}, admitted_as, outcome, state_after, failures FROM s WHERE rn > 0"""


_BREAKER_SQL = _breaker_sql("user_id", "event_type = 'error'", 86_400_000_000)


def _lines_sql() -> str:
    blank = sql_strip("line")
    lines = "string_split(replace(text, ' ', chr(10)), chr(10))"
    return f"""WITH l AS (SELECT conv_id, turn, unnest({lines}) AS line,
          generate_subscripts({lines}, 1) AS line_no FROM conversations),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, line_no) AS rn FROM l),
        e AS (SELECT conv_id, min(rn) AS stop FROM o
              WHERE {sql_strip('lower(line)')} = '{END}' GROUP BY conv_id),
        k AS (SELECT o.* FROM o LEFT JOIN e USING (conv_id)
              WHERE stop IS NULL OR rn < stop),
        b AS (SELECT conv_id, min(rn) AS f, max(rn) AS t FROM k WHERE {blank} <> '' GROUP BY conv_id),
        i AS (SELECT k.conv_id, k.rn, k.rn - f AS place, CASE
            WHEN f = t THEN {blank}
            WHEN k.rn = f THEN regexp_replace(line, '^\\s+', '')
            WHEN k.rn = t THEN regexp_replace(line, '\\s+$', '') ELSE line END AS line
          FROM k JOIN b ON b.conv_id = k.conv_id AND k.rn BETWEEN f AND t),
        p AS (SELECT conv_id, (place // 25)::BIGINT AS page, count(*) AS n_lines,
          md5(string_agg(line, chr(10) ORDER BY rn)) AS h FROM i GROUP BY 1, 2)
        SELECT conv_id, page, n_lines, h FROM p"""


QUERIES = {
    "prev_reuse": (
        prev_reuse,
        f"""WITH t AS ({_TURNS_SQL}),
        p AS (SELECT *, last_value(CASE WHEN NOT goes_on THEN {{'r': NULL, 't': NULL, 'e': false}}
              WHEN processed THEN {{'r': result, 't': task, 'e': is_error}} END
            IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM t)
        SELECT conv_id, turn, b.r AS previous_result,
          coalesce(b.r IS NOT NULL AND b.t = task, false) AS can_use_previous,
          coalesce(b.r IS NOT NULL AND b.t = task, false) AND b.r <> '' AS offer_previous,
          coalesce(b.e, false) AS after_error, result IS NOT NULL AS can_continue FROM p""",
    ),
    "refine_chains": (
        refine_chains,
        f"""WITH t AS ({_TURNS_SQL}),
        b AS (SELECT *, lag(task) OVER w AS pt, lag(result) OVER w AS pr, lag(goes_on) OVER w AS pp
              FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
        c AS (SELECT *, sum(CASE WHEN pr IS NOT NULL AND pp AND pt = task THEN 0 ELSE 1 END)
              OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS chain_no FROM b)
        SELECT conv_id, chain_no, count(*) AS n_turns,
          arg_min(coalesce(result, '-'), turn) AS first_text,
          arg_max(coalesce(result, '-'), turn) AS last_text FROM c GROUP BY 1, 2""",
    ),
    "breaker_replay": (breaker_replay, _BREAKER_SQL),
    "breaker_by_type": (
        breaker_by_type,
        _breaker_sql("event_type", "value > 20", 3_600_000_000),
    ),
    "breaker_stream": (breaker_stream, _BREAKER_SQL),
    "breaker_reordered": (breaker_reordered, _BREAKER_SQL),
    "breaker_late": (
        breaker_late,
        f"""WITH c AS (SELECT user_id, event_id, epoch_us(ts) AS t,
            floor((epoch_us(ts) + event_id * 7919 % 24 * 3600000000)::DOUBLE
              / {_WINDOW_DAYS * 86_400_000_000}::DOUBLE) AS w FROM events),
          m AS (SELECT user_id, w, max(t) AS newest FROM c GROUP BY ALL),
          b AS (SELECT user_id, w, max(newest) OVER (PARTITION BY user_id ORDER BY w
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM m)
        SELECT c.user_id, count(*) AS n_calls,
          count(*) FILTER (WHERE t < b.newest - {6 * 3_600_000_000}) AS n_late
        FROM c JOIN b ON b.user_id = c.user_id AND b.w = c.w GROUP BY 1""",
    ),
    "line_assembly": (line_assembly, _lines_sql()),
    "line_stream": (line_stream, _lines_sql()),
}
