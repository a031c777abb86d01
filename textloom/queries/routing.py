"""Queries that identify languages, route texts and render prompts."""

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import langid
from textloom.operators.routing import (
    add_template,
    chosen_confidence,
    confidence,
    confidences,
    detected,
    direction,
    script_language,
)
from textloom.plans.tasks import prepare
from textloom.plans.templates import TEMPLATES, template_table
from textloom.queries.common import sql_list, sql_str, sql_strip, sql_tokens, table
from textloom.sources.texts import non_blank, spread_out


def lang_confidence(spark, folder):
    text, lang = F.col("text"), detected(F.col("text"), F.col("lang"))
    return table(spark, folder, "documents").select(
        "doc_id", lang.alias("lang"), confidence(text, lang).alias("confidence")
    )


def lang_route(spark, folder):
    # The tables hold no Chinese; German stands in for it to reach every route.
    lang = F.when(F.col("lang") == "de", "zh-cn").otherwise(F.col("lang"))
    docs = table(spark, folder, "documents").select("doc_id", lang.alias("lang"))
    return direction(docs, F.col("lang"))


def auto_translate(spark, folder):
    """Read, strip, route by language, look the template up, render."""
    docs = non_blank(table(spark, folder, "documents").select("doc_id", "text", "lang"))
    lang = F.when(F.col("lang") == "de", "zh-tw").otherwise(F.col("lang"))
    routed = direction(docs.withColumn("lang", lang), F.col("lang"))
    prompted = add_template(routed, template_table(spark))
    prompt = T.render(F.col("template"), F.col("text"))
    return prompted.select(
        "doc_id",
        "task_id",
        "target_language",
        F.length(prompt).cast("bigint").alias("n"),
        F.md5(prompt).alias("h"),
    )


def prompt_render(spark, folder):
    odd = F.concat(F.lit('{"a": {user_text}} '), F.col("text"), F.lit(" {user_text} {}"))
    prompt = T.render(F.lit(TEMPLATES[0][1]), odd)
    return table(spark, folder, "documents").select(
        "doc_id", F.length(prompt).cast("bigint").alias("n"), F.md5(prompt).alias("h")
    )


def _requests(spark, folder):
    """Documents as requests: the source is the model, the length picks the task."""
    task = (
        F.when(F.length("text") < 300, "refine")
        .when(F.length("text") < 900, "refine_presentation")
        .when(F.length("text") < 1500, "summarise")
        .otherwise("auto_translate")
    )
    lang = F.when(F.col("lang") == "de", "zh").otherwise(F.col("lang"))
    return table(spark, folder, "documents").select(
        "doc_id",
        "text",
        lang.alias("lang"),
        F.col("source").alias("model_key"),
        task.alias("task_id"),
    )


def _models(spark, folder):
    """Sources with at least one Spanish document count as available."""
    docs = table(spark, folder, "documents").where("lang = 'es' and source <> 'src3'")
    return docs.select(F.col("source").alias("model_key")).distinct()


def prompt_lookup(spark, folder):
    prepared = prepare(_requests(spark, folder), template_table(spark), _models(spark, folder))
    return prepared.select(
        "doc_id",
        "prompt_task",
        "error",
        F.coalesce(F.length("prompt"), F.lit(0)).cast("bigint").alias("n"),
        F.md5("prompt").alias("h"),
    )


def language_id(spark, folder):
    """Learn the languages from all labelled documents, then identify each document."""
    docs = spread_out(table(spark, folder, "documents").select("doc_id", "text", "lang"))
    profile = langid.fit(docs)
    docs = docs.withColumn("all", confidences(F.col("text")))
    return langid.detect(docs, profile, "doc_id").select(
        "doc_id",
        "detected",
        "log_score",
        chosen_confidence(F.col("all"), F.col("detected")).alias("confidence"),
    )


def language_hold_out(spark, folder):
    """Learn from three fifths of the documents, fit the temperature on another, judge the last.

    How many texts are told right, by language and tenth of the probability they are told
    with.  The split is what the query is about: documents learned from would be no test.
    """
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    profile = langid.fit(docs.where("doc_id % 5 > 1"))
    temperature = langid.fit_temperature(docs.where("doc_id % 5 = 1"), profile, "doc_id")
    found = langid.detect(docs.where("doc_id % 5 = 0"), profile, "doc_id", temperature=temperature)
    right = F.count(F.when(F.col("detected") == F.col("lang"), 1)).alias("n_right")
    tenth = F.least(F.floor(F.round("probability", 9) * 10), F.lit(9)).cast("int").alias("tenth")
    return found.groupBy("lang", tenth).agg(F.count(F.lit(1)).alias("n"), right)


_LATIN, _HAN = "aeiou", "汉字中文语"


def lang_script(spark, folder):
    """Texts whose vowels are written in Chinese characters, all or the first kind only."""
    n = F.length("text")
    text = F.when(n % 3 == 0, F.translate("text", _LATIN, _HAN)).when(
        n % 3 == 1, F.translate("text", _LATIN[0], _HAN[0])
    ).otherwise(F.col("text"))
    docs = table(spark, folder, "documents").select("doc_id", text.alias("text"), "lang")
    return docs.select(
        "doc_id",
        script_language(F.col("text"), F.col("lang")).alias("by_script"),
        confidence(F.col("text"), F.lit("zh-tw")).alias("confidence"),
    )


_TEMPLATE_SQL = ", ".join(f"({sql_str(i)}, {sql_str(t)})" for i, t in TEMPLATES)
_ENGLISH = ["the", "and", "to", "of", "a", "in", "is", "it", "you", "that"]


def _sql_confidence(lang: str) -> str:
    clean = sql_strip("text")
    common = f"len(list_intersect({sql_tokens('text')}, {sql_list(_ENGLISH)}))"
    return f"""CASE WHEN {clean} = '' OR {lang} = 'unknown' THEN 0.0::DOUBLE ELSE
      least(0.7::DOUBLE + least(length({clean})::DOUBLE / 100.0::DOUBLE, 0.2::DOUBLE)
        + CASE WHEN {lang} = 'en' THEN least({common}::DOUBLE / 10.0::DOUBLE, 0.1::DOUBLE)
          ELSE 0.0::DOUBLE END, 1.0::DOUBLE) END"""


_LANGS = ["de", "en", "es", "fr"]
_WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}]+'), lambda w: w <> '')"
_GRAMS = """list_concat(string_split(word, ''),
    list_transform(range(1, length(word) + 1), lambda i: substr(word || ' ', i::INT, 2)),
    list_transform(range(1, length(word) + 1), lambda i: substr(' ' || word || ' ', i::INT, 3)))"""

def _langid_sql(learn: str, tell: str) -> str:
    """Ends with ``best``: the language of each text that ``tell`` picks, learned from ``learn``."""
    return f"""WITH w AS (SELECT doc_id, lang, unnest({_WORDS}) AS word FROM documents),
        dw AS (SELECT doc_id, word, count(*) AS times FROM w WHERE {tell} GROUP BY ALL),
        lw AS (SELECT lang, word, count(*) AS n FROM w WHERE {learn} GROUP BY ALL),
        v AS (SELECT DISTINCT word FROM w),
        wg AS (SELECT word, unnest({_GRAMS}) AS gram FROM v),
        lg AS (SELECT lang, gram, sum(n)::BIGINT AS n FROM lw JOIN wg USING (word) GROUP BY ALL),
        tot AS (SELECT lang, sum(n)::DOUBLE + (SELECT count(DISTINCT gram) FROM lg) AS total
          FROM lg GROUP BY lang),
        lp AS (SELECT tot.lang, g.gram,
          round(ln((coalesce(lg.n, 0) + 1)::DOUBLE / total) * 1000000.0)::BIGINT AS lp
          FROM (SELECT DISTINCT gram FROM wg) g CROSS JOIN tot
          LEFT JOIN lg ON lg.gram = g.gram AND lg.lang = tot.lang),
        ws AS (SELECT word, lang, sum(lp)::BIGINT AS s FROM wg JOIN lp USING (gram) GROUP BY ALL),
        sc AS (SELECT doc_id, lang, sum(times * s)::BIGINT AS s FROM dw JOIN ws USING (word) GROUP BY ALL),
        best AS (SELECT doc_id, lang, s FROM (SELECT *, row_number() OVER (
            PARTITION BY doc_id ORDER BY s DESC, lang) AS rn FROM sc) WHERE rn = 1)"""


QUERIES = {
    "lang_confidence": (
        lang_confidence,
        f"SELECT doc_id, lang, {_sql_confidence('lang')} AS confidence FROM documents",
    ),
    "lang_route": (
        lang_route,
        """WITH d AS (SELECT doc_id, CASE WHEN lang = 'de' THEN 'zh-cn' ELSE lang END AS lang
                     FROM documents)
        SELECT doc_id, lang,
          CASE lang WHEN 'zh-cn' THEN 'Chinese' WHEN 'en' THEN 'English'
            ELSE 'Unknown (' || lang || ')' END AS source_language,
          CASE lang WHEN 'zh-cn' THEN 'English' WHEN 'en' THEN 'Simplified Chinese'
            ELSE 'Refined Text' END AS target_language,
          CASE lang WHEN 'zh-cn' THEN 'zh_to_en' WHEN 'en' THEN 'en_to_zh' ELSE 'refine' END AS task_id
        FROM d""",
    ),
    "auto_translate": (
        auto_translate,
        f"""WITH t(task_id, template) AS (VALUES {_TEMPLATE_SQL}),
        d AS (SELECT doc_id, {sql_strip('text')} AS text,
          CASE lang WHEN 'de' THEN 'zh_to_en' WHEN 'en' THEN 'en_to_zh' ELSE 'refine' END AS task_id,
          CASE lang WHEN 'de' THEN 'English' WHEN 'en' THEN 'Simplified Chinese'
            ELSE 'Refined Text' END AS target_language FROM documents),
        p AS (SELECT doc_id, task_id, target_language, replace(template, '{{user_text}}', text) AS p
              FROM d JOIN t USING (task_id) WHERE text <> '')
        SELECT doc_id, task_id, target_language, length(p)::BIGINT AS n, md5(p) AS h FROM p""",
    ),
    "prompt_render": (
        prompt_render,
        f"""WITH p AS (SELECT doc_id, {sql_str(TEMPLATES[0][1].split('{user_text}')[0])}
            || '{{"a": {{user_text}}}} ' || text || ' {{user_text}} {{}}'
            || {sql_str(TEMPLATES[0][1].split('{user_text}')[1])} AS p FROM documents)
        SELECT doc_id, length(p)::BIGINT AS n, md5(p) AS h FROM p""",
    ),
    "prompt_lookup": (
        prompt_lookup,
        f"""WITH t(prompt_task, template) AS (VALUES {_TEMPLATE_SQL}),
        m AS (SELECT DISTINCT source AS model_key FROM documents
              WHERE lang = 'es' AND source <> 'src3'),
        q AS (SELECT doc_id, text, source AS model_key, lang,
          CASE WHEN length(text) < 300 THEN 'refine' WHEN length(text) < 900 THEN 'refine_presentation'
            WHEN length(text) < 1500 THEN 'summarise' ELSE 'auto_translate' END AS task_id
          FROM documents),
        r AS (SELECT *, CASE WHEN task_id <> 'auto_translate' THEN task_id
          WHEN lang = 'de' THEN 'zh_to_en' WHEN lang = 'en' THEN 'en_to_zh' ELSE 'refine' END
          AS prompt_task FROM q),
        e AS (SELECT r.*, template, CASE
            WHEN m.model_key IS NULL THEN 'Model ''' || r.model_key || ''' not found'
            WHEN template IS NULL THEN 'Prompt for task ''' || task_id || ''' not found' END AS error
          FROM r LEFT JOIN m ON m.model_key = r.model_key LEFT JOIN t ON t.prompt_task = r.prompt_task),
        p AS (SELECT doc_id, prompt_task, error,
          CASE WHEN error IS NULL THEN replace(template, '{{user_text}}', text) END AS p FROM e)
        SELECT doc_id, prompt_task, error, coalesce(length(p), 0)::BIGINT AS n, md5(p) AS h FROM p""",
    ),
    "langid": (
        language_id,
        f"""{_langid_sql("true", "true")},
        d AS (SELECT doc_id, text, coalesce(best.lang, 'unknown') AS detected, s AS log_score
          FROM documents LEFT JOIN best USING (doc_id))
        SELECT doc_id, detected, log_score, {_sql_confidence('detected')} AS confidence FROM d""",
    ),
    "lang_script": (
        lang_script,
        f"""WITH t AS (SELECT doc_id, lang, {sql_strip(f"""CASE length(text) % 3
            WHEN 0 THEN translate(text, '{_LATIN}', '{_HAN}')
            WHEN 1 THEN translate(text, '{_LATIN[0]}', '{_HAN[0]}') ELSE text END""")} AS t FROM documents),
        s AS (SELECT *, length(regexp_replace(t, '[^一-鿿]+', '', 'g'))::DOUBLE / length(t)::DOUBLE AS share
          FROM t)
        SELECT doc_id, CASE WHEN share > 0.1 THEN 'zh-cn' ELSE lang END AS by_script,
          CASE WHEN t = '' THEN 0.0::DOUBLE ELSE least(0.7::DOUBLE
            + least(length(t)::DOUBLE / 100.0::DOUBLE, 0.2::DOUBLE)
            + least(share, 0.1::DOUBLE), 1.0::DOUBLE) END AS confidence FROM s""",
    ),
    "langid_hold_out": (
        language_hold_out,
        f"""{_langid_sql("doc_id % 5 > 1", "doc_id % 5 <= 1")},
        top AS (SELECT doc_id, max(s) AS top FROM sc GROUP BY 1),
        far AS (SELECT sc.doc_id, sc.lang, (sc.s - top.top)::DOUBLE AS far FROM sc JOIN top USING (doc_id)),
        grid AS (SELECT (1000000 * pow(2, k))::DOUBLE AS t FROM range({len(langid.TEMPERATURES)}) g(k)),
        z AS (SELECT doc_id, t, sum(exp(far / t)) AS z FROM far, grid GROUP BY ALL),
        loss AS (SELECT z.t, sum(ln(z) - far.far / z.t) AS loss FROM z
          JOIN documents d ON d.doc_id = z.doc_id AND d.doc_id % 5 = 1
          JOIN far ON far.doc_id = d.doc_id AND far.lang = d.lang GROUP BY 1),
        chosen AS (SELECT arg_min(t, loss) AS t FROM loss),
        told AS (SELECT d.doc_id, d.lang, coalesce(best.lang, 'unknown') = d.lang AS is_right,
            coalesce(round(1.0::DOUBLE / z.z, 9), 0.0) AS p
          FROM documents d LEFT JOIN best USING (doc_id)
          LEFT JOIN (SELECT z.* FROM z JOIN chosen USING (t)) z USING (doc_id) WHERE d.doc_id % 5 = 0)
        SELECT lang, least(floor(p * 10), 9)::INT AS tenth, count(*) AS n,
          count(*) FILTER (WHERE is_right) AS n_right FROM told GROUP BY ALL""",
    ),
}
