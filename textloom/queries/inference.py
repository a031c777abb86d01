"""Queries that run a function over prompts, with a deterministic stand-in for a model."""

from pyspark.sql import functions as F

from textloom import fixed
from textloom.operators.inference import CallFailure, run_callable
from textloom.operators.sessions import previous_results, refinement_chains
from textloom.operators.waves import run_in_waves
from textloom.plans.requests import answer, not_ready
from textloom.plans.tasks import execute, prepare
from textloom.plans.templates import TEMPLATES, template_table
from textloom.queries.common import sql_str, sql_strip, table
from textloom.queries.routing import _models, _requests
from textloom.session import new_folder

PAUSE = 0.0


def echo_factory(name):
    """Answers with the prompt; fails on some junk marks."""

    def run(prompt: str) -> str:
        if "$$$" in prompt:
            raise RuntimeError("code 429")
        if "&&&" in prompt:
            raise RuntimeError("cannot read this")
        return f"[{name}] {prompt}"

    return run


def typed_factory(name):
    """As the echo, but texts with $$$ fail in one of five ways, by their length."""

    def run(prompt: str) -> str:
        if "$$$" in prompt:
            kind = len(prompt) % 5
            if kind == 0:
                raise CallFailure("spent", "quota")
            if kind == 1:
                raise CallFailure("no answer", "api")
            if kind == 2:
                return None
            raise RuntimeError("code 429" if kind == 3 else "cannot read this")
        return f"[{name}] {prompt}"

    return run


def dead_factory(name):
    """Two models fail whatever they are asked."""

    def run(prompt: str) -> str:
        if name in ("src0", "src1"):
            raise RuntimeError("dead")
        return prompt

    return run


def task_waves(spark, folder):
    """Two dead models behind a breaker that all tasks share: a wave of calls each, and no more.

    The clock stands still, so that no breaker tries again.
    """
    docs = table(spark, folder, "documents").select("doc_id", "source", F.substring("text", 1, 80).alias("prompt"))
    wave_rows = 1 + docs.count() // 50
    done = run_in_waves(docs, dead_factory, "source", ["doc_id"], wave_rows=wave_rows, now=lambda: 0.0)
    outcome = F.coalesce("error_type", F.lit("answered")).alias("outcome")
    return done.groupBy("source", outcome).agg(F.count(F.lit(1)).alias("n"), F.sum("attempts").alias("n_calls"))


def other_factory(name):
    """Answers whatever it is asked, in its own way."""

    def run(prompt: str) -> str:
        return f"again {prompt}"

    return run


def journal_resume(spark, folder):
    """A job that stopped halfway and is started again: what had been answered is not asked for again.

    Half the sources are answered by the echo, which fails on some; then all are asked for with
    the same journal, and only what had no answer goes to the other model.
    """
    docs = table(spark, folder, "documents").select("doc_id", "source", F.substring("text", 1, 200).alias("prompt"))
    journal = new_folder(spark, "journal")
    options = {"model": "source", "journal": journal, "key": ["doc_id"], "batch_rows": 500}
    run_callable(docs.where("source < 'src3'"), echo_factory, **options)
    done = run_callable(docs, other_factory, **options)
    return done.select("doc_id", F.md5("result").alias("h"), F.col("call_error").isNull().alias("is_answered"))


def flaky_factory(name):
    """Fails once on a text with ### and always on a text with $$$."""
    seen: dict[str, int] = {}

    def run(prompt: str) -> str:
        tries = seen.pop(prompt, 0) + 1
        if "$$$" in prompt or ("###" in prompt and tries == 1):
            if tries < 3:
                seen[prompt] = tries
            raise RuntimeError("busy")
        return prompt[::-1]

    return run


def batch_map(spark, folder):
    docs = table(spark, folder, "documents").select(
        "doc_id", "source", F.col("text").alias("prompt")
    )
    ran = run_callable(docs, echo_factory, "prompt", "source")
    return ran.select("doc_id", F.md5("result").alias("h"), "call_error")


def retry_map(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", F.col("text").alias("prompt"))
    ran = run_callable(docs, flaky_factory, "prompt", attempts=fixed.RETRY_ATTEMPTS, pause=PAUSE)
    return ran.select(
        "doc_id", F.md5("result").alias("h"), "call_error", F.col("attempts").cast("bigint")
    )


def task_execution(spark, folder):
    """Some requests name no model or no task; failed calls are of all types."""
    n = F.length("text")
    asked = _requests(spark, folder).withColumns(
        {
            "model_key": F.when(n % 13 != 0, F.col("model_key")),
            "task_id": F.when(n % 17 != 0, F.col("task_id")).otherwise(""),
        }
    )
    prepared = prepare(asked, template_table(spark), _models(spark, folder))
    done = execute(prepared.drop("text"), typed_factory, guard=False, concurrency=4)
    return done.select(
        "doc_id",
        "is_error",
        "error_type",
        F.md5("result").alias("h"),
        F.md5("message").alias("message_h"),
    )


def task_breaker(spark, folder):
    """Models that always fail are given up after three calls, through a breaker that all tasks share."""
    docs = table(spark, folder, "documents").select(
        "doc_id",
        F.col("source").alias("model_key"),
        F.col("text").alias("prompt"),
        F.lit(None).cast("string").alias("error"),
        F.lit("refine").alias("error_task"),
    )
    options = {"first_rows": fixed.FAILURE_THRESHOLD, "wave_rows": 1 + docs.count() // 8}
    done = execute(docs, dead_factory, order=["doc_id"], recovery_seconds=1e9, **options)
    return done.groupBy("model_key", "error_type", "error").agg(F.count(F.lit(1)).alias("n"))


def task_sessions(spark, folder):
    """Conversations answered turn by turn, then what each turn may reuse, and its chain."""
    turns = table(spark, folder, "conversations").select(
        "conv_id",
        "turn",
        F.col("text").alias("prompt"),
        F.lit("m").alias("model_key"),
        F.when(F.length("text") < 300, "short").otherwise("long").alias("task_id"),
        F.lit(None).cast("string").alias("error"),
        F.lit("refine").alias("error_task"),
    )
    done = execute(turns, echo_factory, guard=False).drop("prompt")
    columns = ["conv_id"], ["turn"], F.col("task_id"), F.col("result"), F.col("is_error")
    used = previous_results(done, *columns)
    chains = refinement_chains(used, *columns)
    return chains.select(
        "conv_id", "turn", F.md5("previous_result").alias("h"), "can_use_previous", "chain_no"
    )


def request_answers(spark, folder):
    """Documents as JSON requests; short ones arrive broken."""
    n = F.length("text")
    task = F.when(n < 300, "1").when(n < 900, "2").when(n < 1500, "7").otherwise(" 3 ")
    body = F.to_json(
        F.struct(
            F.concat(F.lit(" "), F.col("source")).alias("model"),
            task.alias("task_key"),
            F.col("text"),
        )
    )
    lang = F.when(F.col("lang") == "de", "zh").otherwise(F.col("lang"))
    requests = table(spark, folder, "documents").select(
        "doc_id",
        lang.alias("lang"),
        F.when(n < 100, F.substring(body, 1, 8)).otherwise(body).alias("body"),
    )
    models, templates = _models(spark, folder), template_table(spark)
    answered = answer(requests, models, templates, echo_factory, guard=False)
    return answered.select(
        "doc_id", F.col("http_code").cast("bigint").alias("http_code"), F.md5("answer").alias("h")
    )


def request_refused(spark, folder):
    """Every request while no model could be started."""
    bodies = table(spark, folder, "events").select("event_id", F.col("props").alias("body"))
    refused = not_ready(bodies, "No AI models were successfully initialized.")
    return refused.select(
        "event_id", F.col("http_code").cast("bigint").alias("http_code"), "answer"
    )


_TEMPLATE_SQL = ", ".join(f"({sql_str(i)}, {sql_str(t)})" for i, t in TEMPLATES)

QUERIES = {
    "batch_map": (
        batch_map,
        """SELECT doc_id,
          CASE WHEN contains(text, '$$$') OR contains(text, '&&&') THEN NULL
            ELSE md5('[' || source || '] ' || text) END AS h,
          CASE WHEN contains(text, '$$$') THEN 'code 429'
            WHEN contains(text, '&&&') THEN 'cannot read this' END AS call_error
        FROM documents""",
    ),
    "retry_map": (
        retry_map,
        """SELECT doc_id, CASE WHEN contains(text, '$$$') THEN NULL ELSE md5(list_aggregate(
            list_reverse(string_split(text, '')), 'string_agg', '')) END AS h,
          CASE WHEN contains(text, '$$$') THEN 'busy' END AS call_error,
          CASE WHEN contains(text, '$$$') THEN 3 WHEN contains(text, '###') THEN 2 ELSE 1 END::BIGINT
            AS attempts
        FROM documents""",
    ),
    "task_execution": (
        task_execution,
        f"""WITH t(prompt_task, template) AS (VALUES {_TEMPLATE_SQL}),
        m AS (SELECT DISTINCT source AS model_key FROM documents
              WHERE lang = 'es' AND source <> 'src3'),
        q AS (SELECT doc_id, text, CASE WHEN length(text) % 13 <> 0 THEN source END AS model_key, lang,
          CASE WHEN length(text) % 17 = 0 THEN '' WHEN length(text) < 300 THEN 'refine'
            WHEN length(text) < 900 THEN 'refine_presentation'
            WHEN length(text) < 1500 THEN 'summarise' ELSE 'auto_translate' END AS task_id
          FROM documents),
        r AS (SELECT *, CASE WHEN task_id <> 'auto_translate' THEN task_id
          WHEN lang = 'de' THEN 'zh_to_en' WHEN lang = 'en' THEN 'en_to_zh' ELSE 'refine' END
          AS prompt_task FROM q),
        w AS (SELECT r.doc_id, r.task_id, r.model_key, CASE
            WHEN r.model_key IS NULL THEN 'No model selected' WHEN task_id = '' THEN 'No task selected'
            WHEN m.model_key IS NULL THEN 'Model ''' || r.model_key || ''' not found'
            WHEN template IS NULL THEN 'Prompt for task ''' || task_id || ''' not found' END AS wrong,
            r.model_key IS NULL OR task_id = '' AS unselected,
            replace(template, '{{user_text}}', text) AS prompt
          FROM r LEFT JOIN m ON m.model_key = r.model_key LEFT JOIN t ON t.prompt_task = r.prompt_task),
        k AS (SELECT *, CASE WHEN wrong IS NULL AND contains(prompt, '$$$')
            THEN length(prompt) % 5 END AS kind FROM w),
        e AS (SELECT *, coalesce(wrong, CASE kind
            WHEN 0 THEN 'Google API quota exceeded. Please wait and try again, or select a different model.'
            WHEN 1 THEN 'API error with ' || model_key || ': no answer'
            WHEN 2 THEN 'An unexpected error occurred: the model answered with NoneType, not text'
            WHEN 3 THEN 'API rate limit or quota exceeded. Please wait and try again, or select a different model.'
            WHEN 4 THEN 'An unexpected error occurred: cannot read this' END) AS error,
            CASE kind WHEN 0 THEN 'quota' WHEN 1 THEN 'api' WHEN 2 THEN 'other' WHEN 3 THEN 'other'
              WHEN 4 THEN 'other' END AS error_type,
            '[' || model_key || '] ' || prompt AS result FROM k)
        SELECT doc_id, error IS NOT NULL AS is_error, error_type,
          CASE WHEN error IS NULL THEN md5(result) END AS h,
          md5(CASE WHEN error IS NULL THEN result ELSE 'Error: Processing error in task '''
            || CASE WHEN unselected THEN 'unknown' ELSE task_id END || ''': ' || error END) AS message_h
        FROM e""",
    ),
    "task_waves": (
        task_waves,
        """WITH d AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents),
        o AS (SELECT source, CASE WHEN source NOT IN ('src0', 'src1') THEN 'answered'
            WHEN place <= 1 + (SELECT count(*) FROM documents) // 50 THEN 'other' ELSE 'rejected' END AS outcome FROM d)
        SELECT source, outcome, count(*) AS n,
          sum(CASE WHEN outcome = 'rejected' THEN 0 ELSE 1 END)::BIGINT AS n_calls FROM o GROUP BY ALL""",
    ),
    "journal_resume": (
        journal_resume,
        """SELECT doc_id, md5(CASE WHEN source < 'src3' AND NOT contains(p, '$$$') AND NOT contains(p, '&&&')
            THEN '[' || source || '] ' || p ELSE 'again ' || p END) AS h, true AS is_answered
        FROM (SELECT doc_id, source, substr(text, 1, 200) AS p FROM documents)""",
    ),
    "task_breaker": (
        task_breaker,
        """WITH d AS (SELECT source AS model_key, row_number() OVER (PARTITION BY source) AS k
            FROM documents),
        c AS (SELECT model_key, CASE WHEN model_key NOT IN ('src0', 'src1') THEN NULL
            WHEN k <= 3 THEN 'other' ELSE 'rejected' END AS error_type FROM d)
        SELECT model_key, error_type, CASE error_type
            WHEN 'other' THEN 'An unexpected error occurred: dead'
            WHEN 'rejected' THEN 'API error with ' || model_key || ': Circuit breaker is open for '''
              || model_key || '''. The model has failed repeatedly and is temporarily unavailable.'
            END AS error, count(*) AS n FROM c GROUP BY model_key, error_type""",
    ),
    "task_sessions": (
        task_sessions,
        """WITH t AS (SELECT conv_id, turn, CASE WHEN length(text) < 300 THEN 'short' ELSE 'long' END AS task,
            CASE WHEN NOT contains(text, '$$$') AND NOT contains(text, '&&&')
              THEN '[m] ' || text END AS result FROM conversations),
        b AS (SELECT *, lag(result) OVER w AS pr, lag(task) OVER w AS pt FROM t
              WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
        SELECT conv_id, turn, md5(pr) AS h, pr IS NOT NULL AND pt = task AS can_use_previous,
          sum(CASE WHEN pr IS NOT NULL AND pt = task THEN 0 ELSE 1 END)
            OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS chain_no FROM b""",
    ),
    "request_refused": (
        request_refused,
        """SELECT event_id, 503::BIGINT AS http_code,
          '{"ok":false,"error":"No AI models were successfully initialized."}' AS answer FROM events""",
    ),
    "request_answers": (
        request_answers,
        f"""WITH t(prompt_task, template) AS (VALUES {_TEMPLATE_SQL}),
        m AS (SELECT DISTINCT source AS model FROM documents WHERE lang = 'es' AND source <> 'src3'),
        q AS (SELECT doc_id, lang, source AS model, {sql_strip('text')} AS text,
          length(text) < 100 AS broken, CASE WHEN length(text) < 300 THEN '1'
            WHEN length(text) < 900 THEN '2' WHEN length(text) < 1500 THEN '7' ELSE '3' END AS k
          FROM documents),
        r AS (SELECT q.*, CASE k WHEN '1' THEN 'refine' WHEN '2' THEN 'refine_presentation' ELSE
            CASE lang WHEN 'de' THEN 'zh_to_en' WHEN 'en' THEN 'en_to_zh' ELSE 'refine' END END
            AS prompt_task,
          CASE k WHEN '1' THEN 'Refine Text (Email, Article, etc.)'
            WHEN '2' THEN 'Refine Presentation (Summarize Article)'
            ELSE 'Auto-Translate (Detect Language & Translate)' END AS task,
          CASE WHEN broken THEN 'model is required'
            WHEN k = '7' THEN 'task_key must be one of [''1'', ''2'', ''3'']'
            WHEN text = '' THEN 'text is required'
            WHEN m.model IS NULL THEN 'Unknown model: ' || q.model END AS rejected
          FROM q LEFT JOIN m ON m.model = q.model),
        e AS (SELECT r.*, '[' || model || '] ' || replace(template, '{{user_text}}', text) AS result,
          coalesce(rejected, CASE
            WHEN contains(text, '$$$') THEN 'API rate limit or quota exceeded. Please wait and try again, or select a different model.'
            WHEN contains(text, '&&&') THEN 'An unexpected error occurred: cannot read this' END) AS error
          FROM r JOIN t USING (prompt_task))
        SELECT doc_id, CASE WHEN rejected IS NOT NULL THEN 400 WHEN error IS NOT NULL THEN 500
            ELSE 200 END::BIGINT AS http_code,
          md5(CASE WHEN error IS NULL THEN to_json({{'ok': true, 'result': result, 'model': model,
            'task': task}})::VARCHAR ELSE to_json({{'ok': false, 'error': error}})::VARCHAR END) AS h
        FROM e""",
    ),
}
