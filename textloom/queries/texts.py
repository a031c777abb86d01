"""Queries over texts: reading, cleaning, scalar functions, names and keys."""

from pyspark.sql import functions as F

from textloom import fixed
from textloom.functions import text as T
from textloom.operators.ordered import Ordered
from textloom.queries.common import sql_strip, sql_tokens, table
from textloom.sources.sinks import envelope
from textloom.sources.texts import decode_requests, read_texts

# Marks used on the test texts instead of symbols
JUNK_TAGS = {"###": "[HASH]", "$$$": "[CASH]", "&&&": "[AND]"}


def text_scan(spark, folder):
    texts = read_texts(spark, f"{folder}/documents.parquet")
    return texts.select(
        "doc_id", "source", F.length("text").cast("bigint").alias("n"), F.md5("text").alias("h")
    )


def json_decode(spark, folder):
    kind = F.col("event_type")
    body = (
        F.when(kind == "error", F.substring("props", 1, 4))
        .when(kind == "view", F.replace("props", F.lit('"'), F.lit("'")))
        .when(kind == "purchase", F.concat("props", F.lit("] junk")))
        .otherwise(F.col("props"))
    )
    events = table(spark, folder, "events").select("event_id", body.alias("body"))
    return decode_requests(events, "body", ("k", "missing")).select("event_id", "k", "missing")


def result_envelope(spark, folder):
    docs = table(spark, folder, "documents")
    error = F.when(F.length("text") < 200, F.concat(F.lit("too short: "), F.col("text")))
    result = F.when(F.length("text") <= 5000, F.col("text"))  # no result for the longest
    answer = envelope(result, error, F.concat(F.lit("m/"), F.col("source")), F.lit("Refine"))
    return docs.select(
        "doc_id", F.md5(answer).alias("h"), F.length(answer).cast("bigint").alias("n")
    )


def uni_strip(spark, folder):
    padded = F.concat(F.lit("　\x1c "), F.col("text"), F.lit("  \x85\n"))
    clean = T.strip(padded)
    return table(spark, folder, "documents").select(
        "doc_id", F.length(clean).cast("bigint").alias("n"), F.md5(clean).alias("h")
    )


def distinct_tokens(spark, folder):
    words = F.sort_array(T.tokens(F.col("text")))
    return (
        table(spark, folder, "documents")
        .select("doc_id", words.alias("words"))
        .select(
            "doc_id",
            F.size("words").cast("bigint").alias("n"),
            F.md5(F.array_join("words", " ")).alias("h"),
        )
    )


def replace_map(spark, folder):
    out = T.replace_all(F.col("text"), JUNK_TAGS)
    return table(spark, folder, "documents").select(
        "doc_id",
        (out != F.col("text")).alias("changed"),
        F.length(out).cast("bigint").alias("n"),
        F.md5(out).alias("h"),
    )


def char_share(spark, folder):
    docs = table(spark, folder, "documents")
    return docs.select(
        "doc_id",
        F.round(T.char_share(F.col("text"), "aeiouàâéèêëîïôùûüáíóúäö"), 12).alias("vowels"),
        F.round(T.char_share(F.col("text")), 12).alias("chinese"),
    )


def length_profile(spark, folder):
    n = F.length("text").cast("bigint")
    return (
        table(spark, folder, "documents")
        .groupBy("lang")
        .agg(
            F.count(F.lit(1)).alias("n_docs"),
            F.sum(n).alias("n_chars"),
            F.min(n).alias("shortest"),
            F.max(n).alias("longest"),
        )
        .withColumn("mean_chars", F.col("n_chars").cast("double") / F.col("n_docs").cast("double"))
    )


def cut_at_terminator(spark, folder):
    out = T.cut_at_terminator(F.col("text"), "of.")
    return table(spark, folder, "documents").select(
        "doc_id", F.length(out).cast("bigint").alias("n"), F.md5(out).alias("h")
    )


def basename(spark, folder):
    return table(spark, folder, "pages").select("page_id", T.basename(F.col("url")).alias("base"))


def model_key(spark, folder):
    part = table(spark, folder, "part")
    name = F.when(F.col("p_size") > 40, "").when(F.col("p_size") > 25, F.col("p_name"))
    id_ = F.concat(F.lit("id-"), F.col("p_partkey").cast("string"))
    key = T.composite_key(F.col("p_brand"), T.display_name(name, id_))
    return part.select("p_partkey", key.alias("model_key"))


def split_key(spark, folder):
    slashed = F.concat_ws("/", "p_brand", "p_name", "p_type")
    label = F.concat("p_name", F.lit(" ("), "p_type", F.lit(")"))
    part = table(spark, folder, "part").select(
        "p_partkey",
        F.when(F.col("p_size") < 5, F.col("p_name")).otherwise(slashed).alias("key"),
        label.alias("label"),
    )
    key = F.col("key")
    return part.select(
        "p_partkey",
        T.key_group(key).alias("provider"),
        T.key_group(key, fixed.UNKNOWN_PROVIDER_WEB).alias("provider_web"),
        T.key_name(key).alias("name"),
        T.short_label(F.col("label")).alias("short_label"),
    )


def group_label(spark, folder):
    part = table(spark, folder, "part")
    group = F.when(F.col("p_size") < 10, "xAI").otherwise(F.lower("p_type"))
    mixed = F.concat(group, F.upper(F.col("p_name")))
    return part.select(
        "p_partkey",
        T.group_label(group).alias("label"),
        T.group_label(mixed).alias("long_label"),
        T.group_label_web(mixed).alias("web_label"),
    )


def _gaps(spark, folder, key, **options):
    """Seconds from each event to the next one with the same key."""
    events = table(spark, folder, "events").select("event_id", key, "ts")
    before = Ordered(events, [key], ["ts", "event_id"], **options).previous(
        F.struct("event_id", "ts"), "before"
    )
    gap = before.frame().where(F.col("before").isNotNull())
    return gap.select(
        F.col("before.event_id").alias("event_id"),
        T.elapsed_seconds(F.col("before.ts"), F.col("ts")).alias("seconds"),
    )


def latency(spark, folder):
    return _gaps(spark, folder, "user_id")


def latency_by_type(spark, folder):
    """Few keys with very many events each, so that every key is done in chunks."""
    return _gaps(spark, folder, "event_type", chunk_rows=1000)


def _gaps_sql(key: str) -> str:
    return f"""SELECT event_id, round((epoch_us(nxt) - epoch_us(ts))::DOUBLE / 1e6, 1) AS seconds
        FROM (SELECT event_id, ts, lead(ts) OVER (PARTITION BY {key} ORDER BY ts, event_id) AS nxt
              FROM events) WHERE nxt IS NOT NULL"""


_PADDED = (
    "chr(12288) || chr(28) || ' ' || text || ' ' || chr(8195) || chr(133) || chr(10)"
)
_TAGGED = "replace(replace(replace(text, '###', '[HASH]'), '$$$', '[CASH]'), '&&&', '[AND]')"
_VOWELS = "aeiouàâéèêëîïôùûüáíóúäö"

QUERIES = {
    "text_scan": (
        text_scan,
        f"""SELECT doc_id, source, length(t)::BIGINT AS n, md5(t) AS h
        FROM (SELECT doc_id, source, {sql_strip('text')} AS t FROM documents) WHERE t <> ''""",
    ),
    "json_decode": (
        json_decode,
        """SELECT event_id,
          CASE WHEN json_valid(b) THEN coalesce(json_extract_string(b, '$.k'), '') ELSE '' END AS k,
          '' AS missing
        FROM (SELECT event_id, CASE event_type WHEN 'error' THEN substr(props, 1, 4)
            WHEN 'view' THEN replace(props, '"', chr(39))
            WHEN 'purchase' THEN props || '] junk' ELSE props END AS b FROM events)""",
    ),
    "result_envelope": (
        result_envelope,
        """SELECT doc_id, md5(j) AS h, length(j)::BIGINT AS n FROM (
          SELECT doc_id, CASE WHEN length(text) < 200
            THEN to_json({'ok': false, 'error': 'too short: ' || text})::VARCHAR
            ELSE to_json({'ok': true, 'result': CASE WHEN length(text) <= 5000 THEN text END,
                          'model': 'm/' || source, 'task': 'Refine'})::VARCHAR END AS j
          FROM documents)""",
    ),
    "uni_strip": (
        uni_strip,
        f"""SELECT doc_id, length(t)::BIGINT AS n, md5(t) AS h
        FROM (SELECT doc_id, {sql_strip(_PADDED)} AS t FROM documents)""",
    ),
    "distinct_tokens": (
        distinct_tokens,
        f"""SELECT doc_id, len(w)::BIGINT AS n, md5(array_to_string(w, ' ')) AS h
        FROM (SELECT doc_id, list_sort({sql_tokens('text')}) AS w FROM documents)""",
    ),
    "replace_map": (
        replace_map,
        f"""SELECT doc_id, t <> text AS changed, length(t)::BIGINT AS n, md5(t) AS h
        FROM (SELECT doc_id, text, {_TAGGED} AS t FROM documents)""",
    ),
    "char_share": (
        char_share,
        rf"""SELECT doc_id,
          round(length(regexp_replace(text, '[^{_VOWELS}]+', '', 'g'))::DOUBLE
                / length(text)::DOUBLE, 12) AS vowels,
          round(length(regexp_replace(text, '[^\x{{4e00}}-\x{{9fff}}]+', '', 'g'))::DOUBLE
                / length(text)::DOUBLE, 12) AS chinese
        FROM documents""",
    ),
    "length_profile": (
        length_profile,
        """SELECT lang, count(*) AS n_docs, sum(length(text))::BIGINT AS n_chars,
          min(length(text))::BIGINT AS shortest, max(length(text))::BIGINT AS longest,
          sum(length(text))::DOUBLE / count(*)::DOUBLE AS mean_chars
        FROM documents GROUP BY lang""",
    ),
    "cut_at_terminator": (
        cut_at_terminator,
        f"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
        p AS (SELECT doc_id, ls, list_position(
            list_transform(ls, lambda x: {sql_strip('lower(x)')}), 'of.') AS stop FROM l),
        c AS (SELECT doc_id, {sql_strip("array_to_string(CASE WHEN stop > 0 THEN ls[:stop - 1] ELSE ls END, chr(10))")}
            AS t FROM p)
        SELECT doc_id, length(t)::BIGINT AS n, md5(t) AS h FROM c""",
    ),
    "basename": (
        basename,
        "SELECT page_id, regexp_extract(url, '[^/]*$') AS base FROM pages",
    ),
    "model_key": (
        model_key,
        """SELECT p_partkey, p_brand || '/' || CASE WHEN p_size > 25 AND p_size <= 40 THEN p_name
          ELSE 'id-' || p_partkey END AS model_key FROM part""",
    ),
    "split_key": (
        split_key,
        """SELECT p_partkey,
          CASE WHEN p_size < 5 THEN 'Unknown' ELSE p_brand END AS provider,
          CASE WHEN p_size < 5 THEN 'Other' ELSE p_brand END AS provider_web,
          CASE WHEN p_size < 5 THEN p_name ELSE p_name || '/' || p_type END AS name,
          p_name AS short_label FROM part""",
    ),
    "group_label": (
        group_label,
        """WITH g AS (SELECT p_partkey, CASE WHEN p_size < 10 THEN 'xAI' ELSE lower(p_type) END AS g,
          upper(p_name) AS u FROM part)
        SELECT p_partkey,
          CASE WHEN lower(g) = 'xai' THEN 'xAI' ELSE upper(g[1]) || lower(g[2:]) END AS label,
          upper(g[1]) || lower(g[2:] || u) AS long_label,
          upper(g[1]) || g[2:] || u AS web_label FROM g""",
    ),
    "latency": (latency, _gaps_sql("user_id")),
    "latency_by_type": (latency_by_type, _gaps_sql("event_type")),
}
