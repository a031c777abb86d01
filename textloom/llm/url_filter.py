"""URL filters: rules on hosts and paths, and boosted trees on lexical features (operator 2).

A url that a rule fits gets the rule's verdict. All others are judged by
gradient-boosted trees over length, depth, shares, entropy, counts of parameters
and the record of the host's suffix, trained from labelled urls.
"""

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import fresh, sampled, stored

#: Most labelled urls that the trees are trained on, and their number, depth and seed.
SAMPLE_ROWS, TREES, DEPTH, SEED = 10_000, 10, 3, 7
#: Labelled urls that a suffix needs before its own record outweighs that of all.
SUFFIX_WEIGHT = 20.0
#: Urls are blocked from this probability on.
LEAST_BLOCK = 0.5


def host(url: Column) -> Column:
    """What follows the first ``://`` up to a slash, question mark, hash or the end, A-Z lower-cased."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(?:(?!://).)*+://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host up to a question mark, hash or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(?:(?!://).)*+://[^/?#]*([^?#]*)", 1)


def suffixes(name: Column, most: int) -> Column:
    """The last label of a host, the last two, and so on up to ``most`` of them, or to the whole host."""
    ends = F.sequence(F.lit(1), F.lit(most))
    return F.array_distinct(F.transform(ends, lambda k: F.call_function("substring_index", name, F.lit("."), -k)))


def with_rules(urls: DataFrame, rules: DataFrame, host_col: str, path_col: str) -> tuple[DataFrame, str]:
    """``urls`` with a struct (rule, verdict) of the longest fitting rule; its name is returned too.

    ``rules`` has rule (``host/path``) and verdict. A rule fits its host and all
    subdomains where the path starts with the rule's. Each distinct host meets
    the rules once, by those of its suffixes that are no longer than a rule's host; urls then meet their host's rules in a join
    that Spark broadcasts or splits by size. Of equally long rules the one
    with the longer host wins, then the first by code point.
    """
    cut = F.instr("rule", "/")
    listed = rules.select(
        "rule",
        "verdict",
        F.substring("rule", F.lit(1), cut - 1).alias("_rule_host"),
        F.expr("substring(rule, instr(rule, '/'))").alias("_rule_path"),
    ).distinct()
    own, held = fresh(urls, "_host"), fresh(urls, "_rules")
    most = listed.agg(F.max(F.size(F.split("_rule_host", r"\.")))).first()[0] or 1
    hosts = urls.select(F.col(host_col).alias(own)).filter(F.col(own) != "").distinct()
    order = F.struct(
        (-F.length("rule")).alias("a"),
        (-F.length("_rule_host")).alias("b"),
        F.col("rule").alias("rule"),
        F.col("verdict").alias("verdict"),
        F.col("_rule_path").alias("path"),
    )
    # Written, so that Spark knows its size, and so that the join may split a host's many urls.
    by_host = stored(
        hosts.select(own, F.explode(suffixes(F.col(own), most)).alias("_rule_host"))
        .join(listed, "_rule_host")
        .groupBy(own)
        .agg(F.array_sort(F.collect_list(order)).alias(held)),
        "host-rules",
    )
    out = fresh(urls, "ruled")
    joined = urls.join(by_host, F.col(host_col) == F.col(own), "left")
    fitting = F.get(F.filter(held, lambda r: F.startswith(F.col(path_col), r["path"])), 0)
    ruled = F.struct(fitting["rule"].alias("rule"), fitting["verdict"].alias("verdict"))
    return joined.select(*(urls[c] for c in urls.columns), ruled.alias(out)), out


def _share(url: Column, pattern: str) -> Column:
    kept = F.length(F.regexp_replace(url, pattern, ""))
    return F.when(F.length(url) > 0, (F.length(url) - kept) / F.length(url)).otherwise(0.0)


def _entropy(url: Column) -> Column:
    """Bits per character of a url's own characters."""
    n = F.length(url)
    chars = F.array_sort(F.array_distinct(F.filter(F.split(url, ""), lambda c: c != "")))
    often = F.transform(chars, lambda c: (n - F.length(F.replace(url, c, F.lit("")))) / n)
    return F.when(n > 0, F.aggregate(often, F.lit(0.0), lambda a, p: a - p * F.log2(p))).otherwise(0.0)


def suffix(name: Column) -> Column:
    """The last label of a host."""
    return F.substring_index(name, ".", -1)


def lexical(url: Column) -> dict[str, Column]:
    url = F.coalesce(url, F.lit(""))
    name, rest = host(url), path(url)
    query = F.when(F.contains(url, F.lit("?")), F.regexp_extract(url, r"(?s)\?([^#]*)", 1)).otherwise("")
    count = lambda x, c: F.length(x) - F.length(F.replace(x, F.lit(c), F.lit("")))
    return {
        "length": F.length(url),
        "host_length": F.length(name),
        "host_labels": count(name, ".") + 1,
        "host_hyphens": count(name, "-"),
        "depth": count(rest, "/"),
        "path_length": F.length(rest),
        "digit_share": _share(url, "[0-9]"),
        "host_digit_share": _share(name, "[0-9]"),
        "other_share": _share(url, "[A-Za-z0-9./:]"),
        "entropy": _entropy(url),
        "host_entropy": _entropy(name),
        "parameters": F.when(query != "", count(query, "&") + 1).otherwise(0),
        "query_length": F.length(query),
        "fragment": F.contains(url, F.lit("#")).cast("int"),
        "secure": F.startswith(url, F.lit("https:")).cast("int"),
    }


@dataclass
class UrlModel:
    """Trees, the record of each suffix among the training urls, and that of all of them."""

    trees: GBTClassificationModel | None
    record: DataFrame | None
    everywhere: float
    names: list[str]

    def probability(self, urls: DataFrame, url_col: str) -> tuple[DataFrame, str]:
        """``urls`` with the probability that each is to be blocked; its name is returned too."""
        out = fresh(urls, "block_probability")
        if self.trees is None:
            return urls.withColumn(out, F.lit(self.everywhere)), out
        kept, own = fresh(urls, "urls_row"), F.col(url_col)
        rows = urls.select(F.struct(*(urls[c] for c in urls.columns)).alias(kept))
        rows = rows.withColumn("_url", F.col(f"{kept}.{url_col}") if url_col in urls.columns else own)
        made = _featured(rows, self.record, self.everywhere)
        scored = self.trees.transform(made).withColumn(out, vector_to_array("probability")[1])
        return scored.select(*(F.col(f"{kept}.`{c}`").alias(c) for c in urls.columns), out), out


def _featured(rows: DataFrame, record: DataFrame, everywhere: float) -> DataFrame:
    """Rows with column ``_url``, with a vector of features."""
    columns = lexical(F.col("_url"))
    rows = rows.select("*", *(c.cast("double").alias(f"_f_{k}") for k, c in columns.items()))
    rows = rows.withColumn("_suffix", suffix(host(F.col("_url"))))
    # At most one row for each url of the bounded sample.
    rows = rows.join(F.broadcast(record), "_suffix", "left")
    rows = rows.withColumn("_f_suffix_block", F.coalesce("_block_share", F.lit(everywhere)))
    rows = rows.withColumn("_f_suffix_known", F.coalesce(F.log1p("_seen"), F.lit(0.0)))
    names = [*(f"_f_{k}" for k in columns), "_f_suffix_block", "_f_suffix_known"]
    return VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep").transform(rows)


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "verdict", sample_rows: int = SAMPLE_ROWS) -> UrlModel:
    """Trees from urls labelled ``block`` or ``allow``, at most about ``sample_rows`` of them.

    Null urls and labels are left out, and repeated pairs count once. With labels of one kind only, or
    none, every other url gets the share of blocked labels (none: allowed).
    """
    pairs = labelled.select(F.col(url_col).alias("_url"), (F.col(label_col) == "block").cast("double").alias("label"))
    pairs = stored(sampled(pairs.dropna().distinct(), F.col("_url"), sample_rows), "labelled-urls")
    n, blocked = pairs.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    everywhere = blocked / n if n else 0.0
    if not 0 < blocked < n:
        return UrlModel(None, None, everywhere, [])
    record = pairs.groupBy(suffix(host(F.col("_url"))).alias("_suffix")).agg(
        ((F.sum("label") + SUFFIX_WEIGHT * everywhere) / (F.count("*") + SUFFIX_WEIGHT)).alias("_block_share"),
        F.count("*").cast("double").alias("_seen"),
    )
    record = stored(record, "suffixes")
    made = _featured(pairs, record, everywhere).select("features", "label")
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=32, seed=SEED).fit(made)
    return UrlModel(trees, record, everywhere, list(lexical(F.lit(""))))


def judge(
    pages: DataFrame,
    rules: list[tuple[str, str]],
    url_col: str = "url",
    least: float = LEAST_BLOCK,
    sample_rows: int = SAMPLE_ROWS,
) -> tuple[DataFrame, str]:
    """``pages`` with a struct (host, path, rule, verdict, probability); its name is returned too.

    ``rules`` are pairs of ``host/path`` and ``block`` or ``allow``; the urls that
    they decide are the labelled ones. A null url, or one without ``://``, has an
    empty host and path, fits no rule and is judged by the trees. All rows stay, repeated
    ones too, which count once in training; an empty table gives an empty one.
    """
    spark = pages.sparkSession
    name, rest = fresh(pages, "url_host"), fresh(pages, "url_path")
    urls = pages.withColumn(name, host(F.col(url_col))).withColumn(rest, path(F.col(url_col)))
    listed = spark.createDataFrame(rules, "rule string, verdict string")
    ruled, mark = with_rules(urls, listed, name, rest)
    model = train(ruled.select(F.col(url_col).alias("url"), F.col(f"{mark}.verdict").alias("verdict")), sample_rows=sample_rows)
    scored, p = model.probability(ruled, url_col)
    own = F.when(F.col(p) >= least, "block").otherwise("allow")
    out = fresh(scored, "judged")
    fields = [
        F.col(name).alias("host"),
        F.col(rest).alias("path"),
        F.col(f"{mark}.rule").alias("rule"),
        F.coalesce(f"{mark}.verdict", own).alias("verdict"),
        F.col(p).alias("probability"),
    ]
    return scored.withColumn(out, F.struct(*fields)).drop(name, rest, mark, p), out
