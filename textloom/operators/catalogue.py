"""Curating a catalogue: filters, dated snapshots, grouping, numbering."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from textloom import fixed
from textloom.functions import text as T
from textloom.operators.lookup import lookup_join, small
from textloom.operators.ordered import CHUNK_ROWS, positions
from textloom.session import written

#: Most keywords of a provider that its rows try one after the other, and characters in a q-gram.
LONG_LIST, GRAM = 64, 3


def exclusion_reason(
    id_: Column,
    provider: Column | None = None,
    keywords: Sequence[str] = fixed.NON_TEXT_KEYWORDS,
    by_provider: Mapping[str, Sequence[str]] = fixed.PROVIDER_EXCLUSIONS,
) -> Column:
    """First keyword that rules the entry out, the general ones first; null if it stays."""
    reason = T.first_keyword(id_, keywords)
    if provider is not None:
        for name, words in by_provider.items():
            if words:
                reason = F.coalesce(reason, F.when(provider == name, T.first_keyword(id_, words)))
    return reason


def is_text_entry(
    id_: Column,
    provider: Column | None = None,
    keywords: Sequence[str] = fixed.NON_TEXT_KEYWORDS,
    by_provider: Mapping[str, Sequence[str]] = fixed.PROVIDER_EXCLUSIONS,
    require_any: Sequence[str] = (),
    enabled: bool = True,
) -> Column:
    """Whether an entry stays.  ``require_any`` also asks for one of a list of words."""
    if not enabled:
        return F.lit(True)
    dropped = T.has_any(id_, keywords)
    if provider is not None:
        for name, words in by_provider.items():
            if words:
                own = (provider == name) & T.has_any(id_, words)
                dropped = dropped | F.coalesce(own, F.lit(False))
    keep = ~dropped
    return keep & T.has_any(id_, require_any) if require_any else keep


def exclude_by_rules(
    df: DataFrame, rules: DataFrame, id_: str, provider: str, long_list: int = LONG_LIST
) -> DataFrame:
    """Drop rows whose id contains a keyword that ``rules`` (provider, keyword) lists for them.

    Where every provider has at most ``long_list`` keywords they are one list, which
    its rows look up.  Beyond that keywords are found by an index (``rule_candidates``),
    and no row is held against each keyword.  Rows without an id or provider stay, and
    an empty keyword drops all other rows of its provider.
    """
    listed = rules.where("keyword is not null and provider is not null").select(
        F.col("provider").alias("_provider"), F.lower("keyword").alias("_keyword")
    )
    listed = written(listed.distinct(), "rules")
    longest = listed.groupBy("_provider").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    if longest is None:
        return df
    if longest <= long_list:
        by_provider = listed.groupBy(F.col("_provider").alias(provider)).agg(
            F.collect_set("_keyword").alias("_keywords")
        )
        found = lookup_join(df, by_provider, [provider])
        hit = F.exists("_keywords", lambda k: F.contains(F.lower(F.col(id_)), k))
        return found.where(~F.coalesce(hit, F.lit(False))).select(*df.columns)
    ids = df.select(F.col(provider).alias("_provider"), F.lower(F.col(id_)).alias("_id"))
    hits = rule_candidates(ids, listed).where(F.contains("_id", F.col("_keyword")))
    hits = written(hits.select("_provider", "_id").distinct(), "rule-hits")
    same = (df[provider] == hits["_provider"]) & (F.lower(df[id_]) == hits["_id"])
    return df.join(small(hits), same, "left_anti")


def _grams(text: Column, size: int) -> Column:
    """Distinct runs of ``size`` characters."""
    last = F.length(text) - size + 1
    places = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(size))))


def rule_candidates(ids: DataFrame, listed: DataFrame) -> DataFrame:
    """(_provider, _id, _keyword): distinct ids with the keywords that they may contain.

    ``ids`` (_provider, _id) and ``listed`` (_provider, _keyword) in lower case.  Each
    keyword is filed under that of its q-grams which fewest ids of the provider hold;
    a keyword of which some q-gram is in no id at all is in none and goes.  Ids look
    their own q-grams up.  Keywords shorter than a q-gram are filed under themselves.
    """
    lengths = F.least(F.length("_keyword"), F.lit(GRAM)).alias("size")
    sizes = sorted(r[0] for r in listed.select(lengths).distinct().collect())
    known = ids.join(small(listed.select("_provider").distinct()), "_provider", "left_semi")
    known = known.where(F.col("_id").isNotNull()).distinct()
    every = [_grams(F.col("_id"), size) if size else F.array(F.lit("")) for size in sizes]
    held = known.select("_provider", "_id", F.explode(F.flatten(F.array(*every))).alias("_gram"))
    held = written(held, "id-grams")
    often = held.groupBy("_provider", "_gram").agg(F.count(F.lit(1)).alias("_often"))
    short = F.length("_keyword") < GRAM
    own = F.when(short, F.array("_keyword")).otherwise(_grams(F.col("_keyword"), GRAM))
    filed = listed.select("_provider", "_keyword", F.size(own).alias("_grams"), F.explode(own).alias("_gram"))
    filed = (
        filed.join(often, ["_provider", "_gram"])
        .groupBy("_provider", "_keyword")
        .agg(
            F.min(F.struct("_often", "_gram")).alias("_rarest"),
            F.count(F.lit(1)).alias("_known"),
            F.first("_grams").alias("_grams"),
        )
        .where("_known = _grams")
        .select("_provider", F.col("_rarest._gram").alias("_gram"), "_keyword")
    )
    filed = written(filed, "rule-index")
    return held.join(small(filed), ["_provider", "_gram"]).drop("_gram")


def available(
    id_: Column,
    required: str | None = None,
    retired: Sequence[str] = (),
    actions: Column | None = None,
    action: str | None = None,
) -> Column:
    """Family name contained, no retired prefix, and the wanted action listed or no list given."""
    keep = F.lit(True)
    if required:
        keep = keep & F.contains(F.lower(id_), F.lit(required))
    if retired:
        keep = keep & ~T.starts_with_any(id_, retired)
    if actions is not None and action:
        keep = keep & T.null_or_contains(actions, action)
    return keep


def latest_snapshots(
    df: DataFrame, id_: str = "id", by: Sequence[str] = (), seq: str | None = None
) -> DataFrame:
    """Drop dated copies of an entry that also exists undated; else keep the latest of them.

    Undated rows stay as they are, repeats included.  Dates compare as text.
    Of copies with the same date the first by ``seq`` stays, or without
    ``seq`` the last id.  Both join sides hold each key once, so a base with
    very many copies is as cheap as any other.
    """
    by = list(by)
    columns = df.columns
    rows = df.withColumn("_date", T.snapshot_date(F.col(id_)))
    undated = rows.where(F.col("_date") == "").select(*columns)
    dated = rows.where(F.col("_date") != "").withColumn("_base", T.snapshot_base(F.col(id_)))
    tie = F.col(id_) if seq is None else -F.col(seq)
    latest = dated.groupBy(*by, "_base").agg(
        F.max_by(F.struct(*columns), F.struct("_date", tie.alias("_tie"))).alias("_row")
    )
    present = df.select(
        *[F.col(b).alias(f"_by_{b}") for b in by], F.col(id_).alias("_present")
    ).distinct()
    match = F.col("_base") == F.col("_present")
    for b in by:
        match = match & F.col(b).eqNullSafe(F.col(f"_by_{b}"))
    chosen = latest.join(present, match, "left_anti").select("_row.*")
    return undated.unionByName(chosen)


def last_wins(df: DataFrame, key: str, seq: Column, value: Column, name: str) -> DataFrame:
    """One row per key with the value written last."""
    return df.groupBy(key).agg(F.max_by(value, seq).alias(name))


def group_sizes(df: DataFrame, group: Column, name: str = "label") -> DataFrame:
    """Rows per group, a null group included, and one row where ``is_total`` for all of them."""
    sizes = df.select(group.alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    total = (F.grouping(name) == 1).alias("is_total")
    return sizes.rollup(name).agg(F.sum("n").alias("n"), total)


def distinct_groups(df: DataFrame, key: Column, name: str = "provider") -> DataFrame:
    """Lower-cased groups of all keys that have one."""
    return (
        df.where(F.contains(key, F.lit("/")))
        .select(F.lower(F.substring_index(key, "/", 1)).alias(name))
        .distinct()
    )


def menu(df: DataFrame, key: str, tie: Sequence[str] = (), chunk_rows: int = CHUNK_ROWS):
    """Number all entries 1…n: groups by label, inside a group in natural order of the names.

    Names that compare equal keep the code-point order of their keys.
    """
    shown = (
        df.withColumn("label", T.group_label(T.key_group(F.col(key))))
        .withColumn("name", T.key_name(F.col(key)))
        .withColumn("_natural", T.natural_key(F.col("name")))
    )
    order = ["label", "_natural", key, *tie]
    return positions(shown, [], order, "menu_no", chunk_rows).drop("_natural")


def first_by_prefix(
    df: DataFrame, key: str, prefixes: Sequence[str], order: Column | None = None
) -> DataFrame:
    """For each prefix the first key, in the listed order, that starts with it and a slash."""
    order = F.col(key) if order is None else order
    low = F.lower(F.col(key))
    wanted = F.array(*[F.lit(p.lower()) for p in prefixes])
    hits = F.filter(wanted, lambda p: F.startswith(low, F.concat(p, F.lit("/"))))
    found = df.select(F.explode(hits).alias("prefix"), F.col(key), order.alias("_order"))
    return found.groupBy("prefix").agg(F.min_by(key, "_order").alias("first_key"))
