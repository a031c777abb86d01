"""Queries that curate, group and number a catalogue."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from textloom.functions import text as T
from textloom.operators.catalogue import (
    distinct_groups,
    exclude_by_rules,
    exclusion_reason,
    first_by_prefix,
    group_sizes,
    is_text_entry,
    last_wins,
    latest_snapshots,
    menu,
)
from textloom.operators.lookup import lookup_join
from textloom.operators.ordered import pages, positions
from textloom.plans.catalogue import curate, load, no_models_message
from textloom.queries.common import sql_natural, table
from textloom.session import new_folder
from textloom.sources.listings import initialise, kept_snapshots, with_fallback
from textloom.sources.sinks import split_stream, upsert
from textloom.sources.snapshots import fetched
from textloom.streaming.run import table_stream


def _part_key():
    return F.concat_ws("/", "p_brand", "p_name")


def kw_filter(spark, folder):
    name = F.col("p_name")
    return table(spark, folder, "part").select(
        "p_partkey",
        exclusion_reason(name, keywords=["ring", "hot"]).alias("reason"),
        is_text_entry(name, keywords=["ring", "hot"]).alias("kept"),
    )


def kw_filter_by_group(spark, folder):
    part = table(spark, folder, "part")
    rules = part.where("p_size = 50").select(
        F.col("p_brand").alias("provider"),
        F.upper(F.substring_index("p_name", " ", 1)).alias("keyword"),
    )
    by_provider = {"Brand#2": ["Bolt"], "Brand#17": ["RED", "blue"], "Brand#4": []}
    kept = part.where(is_text_entry(F.col("p_name"), F.col("p_brand"), ["gear"], by_provider))
    return exclude_by_rules(kept, rules, "p_name", "p_brand").select(
        "p_partkey", "p_brand", "p_name"
    )


def snapshot_reuse(spark, folder):
    """A catalogue fetched by five jobs from sources that change: which of them each job sees.

    The second comes within the hour and is given the first fetch; the third comes just as the
    hour is over; the fourth forces a fetch, which finds nothing; so the fifth fetches again.
    """
    part = table(spark, folder, "part").select("p_partkey", "p_brand")
    place = new_folder(spark, "snapshots")
    jobs = [(0, False, 0), (3599, False, 1), (3600, False, 2), (3700, True, None), (3701, False, 3)]
    seen = []
    for job, (at, force, rest) in enumerate(jobs):
        source = part.where(F.col("p_partkey") % 4 == F.lit(rest))
        found = fetched(spark, place, lambda source=source: source, 3600, force, lambda at=at: 1e9 + at)
        seen.append(found.withColumn("job", F.lit(job)))
    return reduce(DataFrame.unionByName, seen)


def _part_ids(part):
    return part.withColumn("id", F.concat_ws("-", "p_partkey", "p_name"))


def kw_filter_long(spark, folder):
    """Rule lists too long to be tried one by one: as many keywords as a brand has parts, some of two characters."""
    part = _part_ids(table(spark, folder, "part"))
    end = F.substring(F.col("p_partkey").cast("string"), -1, 1)
    long = F.concat(end, F.lit("-"), F.substring("p_name", 1, 4))
    keyword = F.when(F.col("p_size") == 3, F.concat(end, F.lit("-"))).otherwise(F.upper(long))
    rules = part.where("p_size % 2 = 1").select(F.col("p_brand").alias("provider"), keyword.alias("keyword"))
    kept = exclude_by_rules(part, rules, "id", "p_brand", long_list=8)
    return kept.select("p_partkey", "p_brand", "id")


def kw_allow(spark, folder):
    name = F.col("p_name")
    return table(spark, folder, "part").select(
        "p_partkey",
        is_text_entry(name, keywords=["hot"], require_any=["widget", "Bolt"]).alias("kept"),
        is_text_entry(name, keywords=["hot"], enabled=False).alias("kept_without_filter"),
    )


def prefix_filter(spark, folder):
    part = table(spark, folder, "part")
    return part.where(~T.starts_with_any(F.col("p_name"), ["small ", "red "])).select(
        "p_partkey", "p_name"
    )


def capability_filter(spark, folder):
    per_conversation = (
        table(spark, folder, "conversations")
        .groupBy("conv_id")
        .agg(F.count(F.lit(1)).alias("n_turns"), F.collect_set("role").alias("roles"))
    )
    listed = F.when(F.col("n_turns") > 2, F.col("roles"))
    return per_conversation.where(T.null_or_contains(listed, "system")).select(
        "conv_id", "n_turns"
    )


def _dated_ids(spark, folder):
    orders = table(spark, folder, "orders").select(
        F.concat(
            F.lit("cust-"),
            F.col("o_custkey").cast("string"),
            F.lit("-"),
            F.date_format("o_orderdate", "yyyy-MM-dd"),
        ).alias("id"),
        F.col("o_custkey").alias("custkey"),
    )
    customers = (
        table(spark, folder, "customer")
        .where("c_acctbal > 0")
        .select(
            F.concat(F.lit("cust-"), F.col("c_custkey").cast("string")).alias("id"),
            F.col("c_custkey").alias("custkey"),
        )
    )
    return orders.unionByName(customers)


_IDS_SQL = """SELECT 'cust-' || o_custkey || '-' || strftime(o_orderdate, '%Y-%m-%d') AS id,
    o_custkey AS custkey FROM orders
  UNION ALL SELECT 'cust-' || c_custkey, c_custkey FROM customer WHERE c_acctbal > 0"""


_CATALOGUE_SQL = rf"""WITH i AS ({_IDS_SQL}),
        l AS (SELECT n_name AS provider, lower(c_mktsegment) || '-' || id AS id, upper(id) AS name,
                lower(c_mktsegment) AS seg
              FROM i JOIN customer ON custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
        k AS (SELECT DISTINCT provider, id, CASE WHEN provider IN ('NATION_0', 'NATION_3') THEN name
                ELSE id END AS name FROM l
          WHERE NOT contains(id, 'house')
            AND NOT (provider = 'NATION_1' AND contains(id, 'machinery'))
            AND NOT (provider = 'NATION_2' AND NOT contains(id, 'cust-1'))
            AND NOT (provider = 'NATION_3' AND starts_with(id, 'auto'))
            AND NOT (provider = 'NATION_4' AND seg NOT IN ('furniture', 'building'))),
        d AS (SELECT *, regexp_extract(id, '-(\d{{4}}-\d{{2}}-\d{{2}}|\d{{4}})(?:-[a-z]+)?$', 1) AS dt,
          regexp_replace(id, '-(\d{{4}}-\d{{2}}-\d{{2}}|\d{{4}})(?:-[a-z]+)?$', '') AS base FROM k),
        m AS (SELECT provider, id, name FROM d WHERE dt = ''
          UNION ALL
          SELECT provider, id, name FROM (
            SELECT *, row_number() OVER (PARTITION BY provider, base ORDER BY dt DESC) AS rn
            FROM d WHERE dt <> '' AND NOT EXISTS
              (SELECT 1 FROM k WHERE k.provider = d.provider AND k.id = d.base)) WHERE rn = 1),
        c AS (SELECT provider, id, provider || '/' || name AS model_key FROM m)"""


def snapshot_dedup(spark, folder):
    return latest_snapshots(_dated_ids(spark, folder).select("id")).select("id")


_RULES = {
    "keywords": ["house"],
    "by_provider": {"NATION_1": ["MACHINERY"]},
    "required": {"NATION_2": "cust-1"},
    "retired": {"NATION_3": ["auto"]},
    "actions": {"NATION_4": "building"},
    "path_named": [f"NATION_{i}" for i in range(25)],
    "named": ["NATION_0", "NATION_3"],
}


def _listing(spark, folder):
    """Orders and customers as a listing, one provider per nation."""
    nations = table(spark, folder, "nation").select("n_nationkey", "n_name")
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("custkey"),
        F.col("c_nationkey").alias("n_nationkey"),
        "c_mktsegment",
    )
    ids = lookup_join(_dated_ids(spark, folder), customers, ["custkey"], "inner")
    ids = lookup_join(ids, nations, ["n_nationkey"], "inner")
    return ids.select(
        F.col("n_name").alias("provider"),
        F.concat(F.lit("models/"), F.lower("c_mktsegment"), F.lit("-"), "id").alias("id"),
        F.upper("id").alias("display_name"),
        F.when(F.col("c_mktsegment") != "FURNITURE", F.array(F.lower("c_mktsegment"))).alias(
            "supported_actions"
        ),
        F.xxhash64("id").alias("seq"),
    )


def snapshot_cases(spark, folder):
    """Parts with four-digit dates, words after them, equal dates and repeated ids."""
    size = F.col("p_size")
    digits = F.lpad((size * 37 % 12 + 1).cast("string"), 4, "0")
    tail = (
        F.when(size % 4 == 0, "")
        .when(size % 4 == 1, F.concat(F.lit("-"), digits))
        .when(size % 4 == 2, F.concat(F.lit("-"), digits, F.lit("-preview")))
        .otherwise(F.concat(F.lit("-2024-05-"), F.lpad((size % 28 + 1).cast("string"), 2, "0")))
    )
    rows = table(spark, folder, "part").select(
        F.col("p_brand").alias("provider"),
        F.concat(F.col("p_type"), F.when(size % 4 == 0, (size % 3).cast("string")).otherwise(""), tail).alias("id"),
        F.col("p_partkey").alias("seq"),
    )
    return latest_snapshots(rows, "id", ["provider"], "seq")


def catalogue(spark, folder):
    return curate(_listing(spark, folder), **_RULES)


def _providers(spark, folder):
    """Nations as providers: whether they can be listed, and their keys."""
    status = (
        F.when(F.col("n_nationkey") % 5 == 1, "error")
        .when(F.col("n_nationkey") % 5 == 2, "no_key")
        .when(F.col("n_nationkey") % 5 == 3, "broken")
        .otherwise("ok")
    )
    key = F.when(~status.isin("no_key") & (F.col("n_nationkey") % 7 != 5), F.lit("a long key"))
    return table(spark, folder, "nation").select(
        F.col("n_name").alias("provider"), status.alias("status"), key.alias("api_key")
    )


def whole_catalogue(spark, folder):
    """Listings, stand-ins from suppliers, keys, a few rows that fail by themselves, and menu numbers."""
    providers = _providers(spark, folder)
    names = table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("provider")
    )
    suppliers = lookup_join(table(spark, folder, "supplier"), names, ["s_nationkey"], "inner")
    fallback = suppliers.select(
        "provider",
        F.concat(F.when(F.col("s_acctbal") < 0, "House-").otherwise("s-"), "s_name").alias("id"),
        F.when(F.col("s_acctbal") > 5000, F.col("s_name")).alias("display_name"),
    )
    error = F.when(F.col("model_key").endswith("7"), "no route")
    entries = load(providers, _listing(spark, folder), fallback, providers, error, **_RULES)
    number = F.coalesce("menu_no", F.lit(0)).alias("menu_no")
    return entries.select("provider", "id", "model_key", "origin", "status", "error", number)


def no_models(spark, folder):
    """The message when no provider has a key."""
    entries = table(spark, folder, "part").select(
        F.col("p_brand").alias("provider"),
        F.concat_ws("/", "p_brand", F.col("p_partkey").cast("string")).alias("model_key"),
    )
    keys = entries.select("provider", F.lit("").alias("api_key")).distinct()
    return no_models_message(initialise(entries, keys), 100).withColumn("message", F.md5("message"))


def last_wins_(spark, folder):
    events = table(spark, folder, "events")
    return last_wins(
        events, "user_id", F.struct("ts", "event_id"), F.col("event_type"), "display_name"
    )


def last_wins_upsert(spark, folder):
    """The same from three batches, none of them in order, each brought into a kept table."""
    events = table(spark, folder, "events").select("user_id", "ts", "event_id", "event_type")
    path = new_folder(spark, "newest")
    for part in range(3):
        kept = upsert(events.where(F.col("event_id") * 7 % 3 == part), path, ["user_id"], ["ts", "event_id"], 8)
    return kept.select("user_id", F.col("event_type").alias("display_name"))


def group_counts(spark, folder):
    suppliers = table(spark, folder, "supplier")
    named = lookup_join(
        suppliers.withColumnRenamed("s_nationkey", "n_nationkey"),
        table(spark, folder, "nation").select("n_nationkey", "n_name"),
        ["n_nationkey"],
        "inner",
    )
    # Suppliers below zero have no group here, which is not the same as all of them.
    group = F.when(F.col("s_acctbal") >= 0, T.group_label(F.col("n_name")))
    return group_sizes(named, group)


def group_lists(spark, folder):
    suppliers = table(spark, folder, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    nations = table(spark, folder, "nation").select("n_nationkey", "n_name")
    named = lookup_join(suppliers, nations, ["n_nationkey"], "inner").select(
        T.group_label(F.col("n_name")).alias("label"), "s_name", "s_suppkey"
    )
    return pages(
        named.withColumn("_natural", T.natural_key(F.col("s_name"))),
        ["label"],
        ["_natural", "s_name", "s_suppkey"],
        F.col("s_name"),
        page_rows=20,
        separator=",",
    )


def distinct_prefix(spark, folder):
    return distinct_groups(table(spark, folder, "part").select(_part_key().alias("k")), F.col("k"))


def first_by_prefix_(spark, folder):
    keys = table(spark, folder, "part").select(_part_key().alias("key"))
    return first_by_prefix(keys, "key", ["BRAND#2", "brand#17", "Brand#1", "none"])


def catalogue_index(spark, folder):
    part = table(spark, folder, "part").select(
        "p_partkey", F.concat(_part_key(), F.lit("-"), F.col("p_size").cast("string")).alias("key")
    )
    return menu(part, "key", ["p_partkey"]).select("menu_no", "p_partkey", "label", "name")


def natural_sort(spark, folder):
    part = table(spark, folder, "part").select(
        "p_partkey", F.concat("p_brand", F.lit("."), F.col("p_size").cast("string")).alias("id")
    )
    keyed = part.withColumn("_natural", T.natural_key(F.col("id")))
    return positions(keyed, [], ["_natural", "id", "p_partkey"], "position").drop("_natural")


def code_point_sort(spark, folder):
    part = table(spark, folder, "part").select("p_partkey", _part_key().alias("key"))
    return positions(part, [], ["key", "p_partkey"], "position")


def source_fallback(spark, folder):
    nation = table(spark, folder, "nation")
    status = (
        F.when(F.col("n_regionkey") == 3, "error")
        .when(F.col("n_regionkey") == 4, "no_key")
        .otherwise("ok")
    )
    sources = nation.select(F.col("n_name").alias("provider"), status.alias("status"))
    names = nation.select("n_nationkey", F.col("n_name").alias("provider"))
    primary = table(spark, folder, "supplier").select(
        F.col("s_nationkey").alias("n_nationkey"), F.col("s_name").alias("id")
    )
    fallback = table(spark, folder, "customer").select(
        F.col("c_nationkey").alias("n_nationkey"),
        F.concat(
            F.when(F.col("c_acctbal") > 5000, "Video-").otherwise("text-"),
            F.col("c_custkey").cast("string"),
        ).alias("id"),
    )
    return with_fallback(
        sources,
        lookup_join(primary, names, ["n_nationkey"], "inner").select("provider", "id"),
        lookup_join(fallback, names, ["n_nationkey"], "inner").select("provider", "id"),
        id_="id",
    )


def ttl_snapshot(spark, folder):
    events = table(spark, folder, "events")
    now = events.agg(F.max("ts")).scalar()
    payload = F.when(F.col("event_type") != "view", F.col("props")).otherwise("")
    kept = kept_snapshots(events, "user_id", "ts", payload, now, ttl_seconds=86_400)
    return kept.select(
        "user_id",
        F.unix_micros(F.col("fetched_at").cast("timestamp")).alias("fetched_us"),
        "payload",
        "reuse",
    )


def _split_parts(spark, folder):
    """Entries with the names of their providers, credentials, and what makes an entry fail by itself."""
    nation = table(spark, folder, "nation")
    customer = table(spark, folder, "customer").withColumnRenamed("c_nationkey", "n_nationkey")

    def entries(some):
        named = lookup_join(some, nation.select("n_nationkey", "n_name"), ["n_nationkey"], "inner")
        return named.select(
            "c_custkey",
            "c_acctbal",
            F.col("n_name").alias("provider"),
            F.concat_ws("/", "n_name", "c_name").alias("model_key"),
        )

    keys = nation.select(
        F.col("n_name").alias("provider"),
        F.when(F.col("n_regionkey") != 0, F.concat(F.lit("key-"), "n_name")).alias("api_key"),
    )
    error = F.when(F.col("c_acctbal") < 0, F.lit("negative balance"))
    return customer, lambda some: initialise(entries(some), keys, row_error=error)


def ok_error_split(spark, folder):
    customer, split = _split_parts(spark, folder)
    return split(customer).select("c_custkey", "status", "error")


def ok_error_stream(spark, folder):
    """The same over a stream, written by status and read back."""
    customer, split = _split_parts(spark, folder)
    source = table(spark, folder, "customer").schema
    stream = table_stream(spark, folder, "customer", source)
    stream = stream.withColumnRenamed("c_nationkey", "n_nationkey")
    to = new_folder(spark, "split")
    return split_stream(stream, f"{to}/out", f"{to}/progress", split).select("c_custkey", "status", "error")


_LAST_SQL = """SELECT user_id, arg_max(event_type, (ts, event_id)) AS display_name
FROM events GROUP BY user_id"""
_SPLIT_SQL = """SELECT c_custkey,
  CASE WHEN n_regionkey = 0 OR c_acctbal < 0 THEN 'failed' ELSE 'ok' END AS status,
  CASE WHEN n_regionkey = 0
    THEN upper(n_name[1]) || lower(n_name[2:]) || ' API Key not found.'
  WHEN c_acctbal < 0 THEN
    'Failed to initialize ' || n_name || '/' || c_name || ': negative balance' END AS error
FROM customer JOIN nation ON c_nationkey = n_nationkey"""

QUERIES = {
    "kw_filter": (
        kw_filter,
        """SELECT p_partkey, CASE WHEN contains(lower(p_name), 'ring') THEN 'ring'
          WHEN contains(lower(p_name), 'hot') THEN 'hot' END AS reason,
          NOT (contains(lower(p_name), 'ring') OR contains(lower(p_name), 'hot')) AS kept
        FROM part""",
    ),
    "kw_filter_by_group": (
        kw_filter_by_group,
        """WITH r AS (SELECT DISTINCT p_brand AS b, lower(split_part(p_name, ' ', 1)) AS k
                     FROM part WHERE p_size = 50)
        SELECT p_partkey, p_brand, p_name FROM part p
        WHERE NOT contains(lower(p_name), 'gear')
          AND NOT (p_brand = 'Brand#2' AND contains(lower(p_name), 'bolt'))
          AND NOT (p_brand = 'Brand#17' AND (contains(lower(p_name), 'red')
                                             OR contains(lower(p_name), 'blue')))
          AND NOT EXISTS (SELECT 1 FROM r WHERE r.b = p.p_brand AND contains(lower(p.p_name), r.k))""",
    ),
    "snapshot_reuse": (
        snapshot_reuse,
        """SELECT p_partkey, p_brand, job FROM part
        JOIN (VALUES (0::INT, 0), (1, 0), (2, 2), (4, 3)) j(job, rest) ON p_partkey % 4 = rest""",
    ),
    "kw_filter_long": (
        kw_filter_long,
        """WITH p AS (SELECT p_partkey, p_brand, p_size, p_partkey || '-' || p_name AS id,
            right(p_partkey::VARCHAR, 1) AS last_digit, p_name FROM part),
        r AS (SELECT DISTINCT p_brand AS b, CASE WHEN p_size = 3 THEN last_digit || '-'
            ELSE lower(last_digit || '-' || left(p_name, 4)) END AS k FROM p WHERE p_size % 2 = 1)
        SELECT p_partkey, p_brand, id FROM p
        WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.b = p.p_brand AND contains(lower(p.id), r.k))""",
    ),
    "kw_allow": (
        kw_allow,
        """SELECT p_partkey, NOT contains(lower(p_name), 'hot') AND (contains(lower(p_name), 'widget')
          OR contains(lower(p_name), 'bolt')) AS kept, true AS kept_without_filter FROM part""",
    ),
    "prefix_filter": (
        prefix_filter,
        """SELECT p_partkey, p_name FROM part
        WHERE NOT (starts_with(lower(p_name), 'small ') OR starts_with(lower(p_name), 'red '))""",
    ),
    "capability_filter": (
        capability_filter,
        """SELECT conv_id, count(*) AS n_turns FROM conversations GROUP BY conv_id
        HAVING count(*) <= 2 OR bool_or(role = 'system')""",
    ),
    "snapshot_dedup": (
        snapshot_dedup,
        rf"""WITH i AS ({_IDS_SQL}),
        d AS (SELECT id, regexp_extract(id, '-(\d{{4}}-\d{{2}}-\d{{2}}|\d{{4}})(?:-[a-z]+)?$', 1) AS dt,
          regexp_replace(id, '-(\d{{4}}-\d{{2}}-\d{{2}}|\d{{4}})(?:-[a-z]+)?$', '') AS base FROM i)
        SELECT id FROM d WHERE dt = ''
        UNION ALL
        SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY base ORDER BY dt DESC, id DESC) AS rn
                        FROM d WHERE dt <> '' AND base NOT IN (SELECT id FROM i)) WHERE rn = 1""",
    ),
    "snapshot_cases": (
        snapshot_cases,
        r"""WITH i AS (SELECT p_brand AS provider, p_partkey AS seq, p_size AS s,
            lpad((p_size * 37 % 12 + 1)::VARCHAR, 4, '0') AS dd, p_type FROM part),
        r AS (SELECT provider, seq, p_type || CASE s % 4 WHEN 0 THEN (s % 3)::VARCHAR
            WHEN 1 THEN '-' || dd WHEN 2 THEN '-' || dd || '-preview'
            ELSE '-2024-05-' || lpad((s % 28 + 1)::VARCHAR, 2, '0') END AS id FROM i),
        d AS (SELECT *, regexp_extract(id, '-(\d{4}-\d{2}-\d{2}|\d{4})(?:-[a-z]+)?$', 1) AS dt,
          regexp_replace(id, '-(\d{4}-\d{2}-\d{2}|\d{4})(?:-[a-z]+)?$', '') AS base FROM r)
        SELECT provider, id, seq FROM d WHERE dt = ''
        UNION ALL
        SELECT provider, id, seq FROM (SELECT *, row_number() OVER (
            PARTITION BY provider, base ORDER BY dt DESC, seq) AS rn FROM d WHERE dt <> ''
            AND NOT EXISTS (SELECT 1 FROM r WHERE r.provider = d.provider AND r.id = d.base)) WHERE rn = 1""",
    ),
    "catalogue": (catalogue, f"""{_CATALOGUE_SQL}
        SELECT provider, id, model_key FROM c"""),
    "whole_catalogue": (
        whole_catalogue,
        rf"""{_CATALOGUE_SQL},
        p AS (SELECT *, n_nationkey % 5 AS s, n_nationkey % 5 <> 2 AND n_nationkey % 7 <> 5 AS has_key
              FROM nation),
        f AS (SELECT n_name AS provider, CASE WHEN s_acctbal < 0 THEN 'House-' ELSE 's-' END || s_name
            AS id, n_name || '/' || CASE WHEN s_acctbal > 5000 THEN s_name
              ELSE CASE WHEN s_acctbal < 0 THEN 'House-' ELSE 's-' END || s_name END AS model_key
          FROM supplier JOIN nation ON s_nationkey = n_nationkey),
        a AS (SELECT provider, id, model_key, 'primary' AS origin, has_key
            FROM c JOIN p ON n_name = provider WHERE s IN (0, 4)
          UNION ALL SELECT provider, id, model_key, 'fallback', has_key
            FROM f JOIN p ON n_name = provider WHERE s IN (1, 2) AND NOT contains(lower(id), 'house')
              AND NOT (provider = 'NATION_1' AND contains(lower(id), 'machinery'))),
        e AS (SELECT *, CASE WHEN NOT has_key
            THEN upper(provider[1]) || lower(provider[2:]) || ' API Key not found.'
            WHEN ends_with(model_key, '7') THEN 'Failed to initialize ' || model_key || ': no route'
            END AS error FROM a),
        g AS (SELECT *, split_part(model_key, '/', 1) AS grp,
            substr(model_key, instr(model_key, '/') + 1) AS name FROM e)
        SELECT provider, id, model_key, origin, CASE WHEN error IS NULL THEN 'ok' ELSE 'failed' END
            AS status, error, CASE WHEN error IS NULL THEN row_number() OVER (
              PARTITION BY error IS NULL ORDER BY upper(grp[1]) || lower(grp[2:]),
              {sql_natural('name')}, model_key, id, origin) ELSE 0 END AS menu_no FROM g""",
    ),
    "no_models": (
        no_models,
        """WITH e AS (SELECT p_brand || '/' || p_partkey AS k, '- ' || p_brand || '/' || p_partkey || ': '
            || upper(p_brand[1]) || lower(p_brand[2:]) || ' API Key not found.' AS item FROM part),
        n AS (SELECT *, (row_number() OVER (ORDER BY k) - 1) // 100 AS page FROM e)
        SELECT page::BIGINT AS page, md5(CASE WHEN page = 0 THEN
            'No AI models were successfully initialized.' || chr(10) || 'Errors:' || chr(10) ELSE '' END
            || string_agg(item, chr(10) ORDER BY k)) AS message FROM n GROUP BY page""",
    ),
    "last_wins": (last_wins_, _LAST_SQL),
    "last_wins_upsert": (last_wins_upsert, _LAST_SQL),
    "group_counts": (
        group_counts,
        """SELECT label, count(*) AS n, grouping(label) = 1 AS is_total FROM (
          SELECT CASE WHEN s_acctbal >= 0 THEN upper(n_name[1]) || lower(n_name[2:]) END AS label
          FROM supplier JOIN nation ON s_nationkey = n_nationkey) GROUP BY ROLLUP (label)""",
    ),
    "group_lists": (
        group_lists,
        f"""WITH s AS (SELECT upper(n_name[1]) || lower(n_name[2:]) AS label, s_name, row_number() OVER (
            PARTITION BY n_name ORDER BY {sql_natural('s_name')}, s_name, s_suppkey) AS rn
          FROM supplier JOIN nation ON s_nationkey = n_nationkey)
        SELECT label, ((rn - 1) // 20)::BIGINT AS page, count(*) AS n_items,
          string_agg(s_name, ',' ORDER BY rn) AS items FROM s GROUP BY 1, 2""",
    ),
    "distinct_prefix": (
        distinct_prefix,
        "SELECT DISTINCT lower(p_brand) AS provider FROM part",
    ),
    "first_by_prefix": (
        first_by_prefix_,
        """SELECT lower(p) AS prefix, min(p_brand || '/' || p_name) AS first_key
        FROM part, (VALUES ('BRAND#2'), ('brand#17'), ('Brand#1'), ('none')) v(p)
        WHERE starts_with(lower(p_brand || '/' || p_name), lower(p) || '/') GROUP BY 1""",
    ),
    "catalogue_index": (
        catalogue_index,
        f"""WITH k AS (SELECT p_partkey, p_brand || '/' || p_name || '-' || p_size AS key,
            upper(p_brand[1]) || lower(p_brand[2:]) AS label, p_name || '-' || p_size AS name FROM part)
        SELECT row_number() OVER (ORDER BY label, {sql_natural('name')}, key, p_partkey) AS menu_no,
          p_partkey, label, name FROM k""",
    ),
    "natural_sort": (
        natural_sort,
        f"""WITH k AS (SELECT p_partkey, p_brand || '.' || p_size AS id FROM part)
        SELECT p_partkey, id,
          row_number() OVER (ORDER BY {sql_natural('id')}, id, p_partkey) AS position FROM k""",
    ),
    "code_point_sort": (
        code_point_sort,
        """SELECT p_partkey, p_brand || '/' || p_name AS key,
          row_number() OVER (ORDER BY p_brand || '/' || p_name, p_partkey) AS position FROM part""",
    ),
    "source_fallback": (
        source_fallback,
        """SELECT n_name AS provider, s_name AS id, 'primary' AS origin
        FROM supplier JOIN nation ON s_nationkey = n_nationkey
        WHERE n_regionkey NOT IN (3, 4)
        UNION ALL SELECT n_name, 'text-' || c_custkey, 'fallback'
        FROM customer JOIN nation ON c_nationkey = n_nationkey
        WHERE c_acctbal <= 5000 AND n_regionkey IN (3, 4)""",
    ),
    "ttl_snapshot": (
        ttl_snapshot,
        """WITH l AS (SELECT user_id, max(ts) AS t,
            arg_max(CASE WHEN event_type <> 'view' THEN props ELSE '' END, ts) AS payload
          FROM events GROUP BY user_id)
        SELECT user_id, epoch_us(t) AS fetched_us, payload,
          epoch_us((SELECT max(ts) FROM events)) - epoch_us(t) < 86400000000 AND payload <> '' AS reuse
        FROM l""",
    ),
    "ok_error_split": (ok_error_split, _SPLIT_SQL),
    "ok_error_stream": (ok_error_stream, _SPLIT_SQL),
}
