"""The whole catalogue: list or fall back, filter, drop old snapshots, name, initialise, number."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from textloom import fixed
from textloom.functions import text as T
from textloom.operators.catalogue import available, is_text_entry, latest_snapshots, menu
from textloom.operators.lookup import lookup_join, reference_table
from textloom.operators.ordered import pages
from textloom.session import written
from textloom.sources.listings import ERROR, NO_KEY, OK, initialise


def curate(
    listed: DataFrame,
    keywords: Sequence[str] = fixed.NON_TEXT_KEYWORDS,
    by_provider: Mapping[str, Sequence[str]] = fixed.PROVIDER_EXCLUSIONS,
    required: Mapping[str, str] = fixed.REQUIRED_SUBSTRING,
    retired: Mapping[str, Sequence[str]] = fixed.RETIRED_PREFIXES,
    actions: Mapping[str, str] = fixed.REQUIRED_ACTION,
    path_named: Sequence[str] = fixed.PATH_PROVIDERS,
    named: Sequence[str] = fixed.NAMED_PROVIDERS,
) -> DataFrame:
    """Text entries of a listing (provider, id, display_name, supported_actions, seq).

    Ids of ``path_named`` providers lose their path, and entries of ``named``
    providers go by their display name; of several the last one.  The filters run before the snapshots are looked at,
    so a base that was filtered out does not hide its dated copies.  Returns
    provider, id and model_key.
    """
    is_path = F.col("provider").isin(list(path_named))
    rows = listed.withColumn("id", F.when(is_path, T.basename(F.col("id"))).otherwise(F.col("id")))
    keep = is_text_entry(F.col("id"), F.col("provider"), keywords, by_provider)
    for provider in sorted({*required, *retired, *actions}):
        own = available(
            F.col("id"),
            required.get(provider),
            retired.get(provider, ()),
            F.col("supported_actions"),
            actions.get(provider),
        )
        keep = keep & ((F.col("provider") != provider) | own)
    kept = rows.where(keep)
    shown = F.when(F.col("provider").isin(list(named)), F.col("display_name"))
    names = kept.withColumn("name", T.display_name(shown, F.col("id")))
    names = names.groupBy("provider", "id").agg(
        F.max_by("name", "seq").alias("name"), F.min("seq").alias("seq")
    )
    # Used three times below; without this the listing would be read three times.
    names = written(names, "names")
    chosen = latest_snapshots(names, "id", ["provider"], "seq")
    return chosen.select(
        "provider", "id", T.composite_key(F.col("provider"), F.col("name")).alias("model_key")
    )


def load(
    sources: DataFrame,
    listed: DataFrame,
    fallback: DataFrame,
    credentials: DataFrame,
    row_error: Column | None = None,
    **rules,
) -> DataFrame:
    """All entries that a user could choose, and those that could not be started.

    ``sources`` says of each provider (status) whether it could be listed.  Listed
    entries are curated by ``rules``.  Where listing failed or there was no key the
    provider's entries of ``fallback`` (provider, id, display_name) stand in: they
    pass the text filter only, and keep their dated copies.  Then each entry is
    initialised with its provider's key of ``credentials``.  Returns provider, id,
    model_key, origin, status, error, and menu_no, 1 to n over the good ones.
    """
    fetched = sources.where(F.col("status") == OK).select("provider")
    failed = sources.where(F.col("status").isin(ERROR, NO_KEY)).select("provider")
    primary = curate(lookup_join(listed, fetched, ["provider"], "left_semi"), **rules)
    words = {k: rules[k] for k in ("keywords", "by_provider") if k in rules}
    kept = fallback.where(is_text_entry(F.col("id"), F.col("provider"), **words))
    name = T.display_name(F.col("display_name"), F.col("id"))
    stand_in = lookup_join(kept, failed, ["provider"], "left_semi").select(
        "provider", "id", T.composite_key(F.col("provider"), name).alias("model_key")
    )
    entries = primary.withColumn("origin", F.lit("primary")).unionByName(
        stand_in.withColumn("origin", F.lit("fallback"))
    )
    started = written(initialise(entries, credentials, row_error=row_error), "entries")
    columns = started.columns
    good = menu(started.where("status = 'ok'"), "model_key", ["id", "origin"])
    bad = started.where("status <> 'ok'").withColumn("menu_no", F.lit(None).cast("bigint"))
    return good.select(*columns, "menu_no").unionByName(bad)


def no_models_message(entries: DataFrame, page_rows: int = 1000) -> DataFrame:
    """What ends the program when nothing could be started: page, message; no row otherwise.

    ``entries`` has model_key, status and error.  The first page begins with the
    message; the errors follow by key, or a hint when there are none.
    """
    good, every = entries.agg(
        F.count(F.when(F.col("status") == "ok", 1)), F.count(F.lit(1))
    ).first()
    head = fixed.MSG_NO_MODELS + "\n"
    if not every:
        rows = [(0, head + fixed.MSG_NO_MODELS_HINT)]
        return reference_table(entries.sparkSession, rows, {"page": "int64", "message": "string"})
    bad = entries.where("status <> 'ok'" if not good else "false")
    item = F.concat(F.lit("- "), F.col("model_key"), F.lit(": "), F.col("error"))
    listed = pages(bad, [], ["model_key", "error"], item, page_rows)
    first = F.concat(F.lit(head + fixed.MSG_NO_MODELS_ERRORS + "\n"), F.col("items"))
    message = F.when(F.col("page") == 0, first).otherwise(F.col("items")).alias("message")
    return listed.select("page", message)
