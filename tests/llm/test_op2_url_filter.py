"""URL filter: hosts, paths and rules against plain Python; the trees on held-out urls."""

import random
import re

import pytest
from pyspark.sql import functions as F

from textloom.llm import queries, url_filter

RULES = queries.URL_RULES


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def plain_rule(url, rules):
    host, path = plain_parts(url)
    fits = []
    for rule, verdict in rules:
        name, slash, rest = rule.partition("/")
        if host and (host == name or host.endswith("." + name)) and path.startswith(slash + rest):
            fits.append((-len(rule), -len(name), rule, verdict))
    return min(fits)[2:] if fits else (None, None)


URLS = [
    "http://a.net/",
    "http://a.net",
    "https://NET/x?y#z",
    "http://planet/",
    "http://www.example.net/en/1.html?a=1&b=2",
    "http://example.net/en",
    "http://example.com/de/a/b",
    "http://notexample.com/de/a",
    "ftp://x.ORG/fr/?q=http://a.net/",
    "http://É.org/fr/",
    "http://user:pw@example.com:80/de/",
    "no scheme.net/",
    "://",
    "://net/",
    "http:///path",
    "a://b://c.net/",
    "http://a.net?x/y",
    "http://a.net#/",
    "http://x.y\n.net/en\n/",
    "",
    None,
    "http://" + "a" * 50_000 + ".net/" + "b" * 50_000,
    "http://...net/",
    "http://.net/",
]


def judged(spark, urls, rules=RULES, **options):
    rows = [(k, u, "h", "r", 1) for k, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, url_host string, rule string, judged int")
    found, out = url_filter.judge(pages, rules, **options)
    assert found.columns[: len(pages.columns)] == pages.columns
    return {r.page_id: r[out] for r in found.collect()}


def test_hosts_paths_and_rules(spark):
    found = judged(spark, URLS)
    assert len(found) == len(URLS)
    for k, url in enumerate(URLS):
        rule, verdict = plain_rule(url, RULES)
        assert (found[k].host, found[k].path) == plain_parts(url), url
        assert found[k].rule == rule, url
        assert found[k].verdict == verdict if rule else found[k].verdict in ("allow", "block")


def test_ties_and_nested_rules(spark):
    rules = [("c.org/ab", "block"), ("org/abcd", "allow"), ("b.c.org/", "allow"), ("c.org/", "block"), ("c.org/ab", "block")]
    urls = [f"http://{h}/{p}" for h in ("org", "c.org", "b.c.org", "x.b.c.org", "bc.org") for p in ("", "ab", "abcd", "b")]
    found = judged(spark, urls, rules)
    assert [found[k].rule for k in range(len(urls))] == [plain_rule(u, rules)[0] for u in urls]


def test_empty_and_one_sided_tables(spark):
    assert judged(spark, []) == {}
    only = judged(spark, ["http://x.net/", "http://y.de/", None])
    assert [only[k].verdict for k in range(3)] == ["block"] * 3  # all that is known is blocked
    none = judged(spark, ["http://y.de/", "http://z.de/q", None])
    assert {r.verdict for r in none.values()} == {"allow"}


def made_urls(n, seed):
    """Blocked ones are long, full of digits and parameters; one in fifty is labelled wrongly."""
    draw = random.Random(seed)
    out = []
    for k in range(n):
        bad = draw.random() < 0.4
        word = lambda m: "".join(draw.choice("abcdefghij") for _ in range(m))
        if bad:
            url = f"http://{word(6)}{draw.randint(1000, 99999)}.{draw.choice(['info', 'com'])}/{word(4)}?" + "&".join(f"{word(2)}={draw.randint(0, 10**6)}" for _ in range(draw.randint(2, 5)))
        else:
            url = f"https://{word(7)}.{draw.choice(['org', 'com'])}/{word(5)}/{word(4)}"
        out.append((url, "block" if bad != (draw.random() < 0.02) else "allow", bad))
    return out


def test_trees_on_held_out_urls(spark):
    labelled = spark.createDataFrame([r[:2] for r in made_urls(1500, 1)], "url string, verdict string")
    model = url_filter.train(labelled)
    other = made_urls(600, 2)
    urls = spark.createDataFrame([(u, b) for u, _, b in other], "url string, bad boolean")
    scored, p = model.probability(urls, "url")
    right = scored.filter((F.col(p) >= 0.5) == F.col("bad")).count()
    assert right / len(other) > 0.95


def test_the_sample_is_bounded(spark):
    labelled = spark.createDataFrame([r[:2] for r in made_urls(2000, 3)], "url string, verdict string")
    model = url_filter.train(labelled, sample_rows=300)
    assert 200 < model.record.agg(F.sum("_seen")).first()[0] < 400


def test_lexical_features(spark):
    row = spark.createDataFrame([("https://ab-1.example.org/x/y9?a=1&b=2#c",)], "u string")
    found = row.select(*(c.alias(k) for k, c in url_filter.lexical(F.col("u")).items())).first()
    assert (found.length, found.depth, found.parameters, found.host_labels) == (39, 2, 2, 3)
    assert (found.host_hyphens, found.secure, found.fragment, found.query_length) == (1, 1, 1, 7)
    assert found.digit_share == pytest.approx(4 / 39)
    flat = spark.createDataFrame([("aabb",)], "u string").select(url_filter._entropy(F.col("u"))).first()
    assert flat[0] == pytest.approx(1.0)


def test_query(spark, folder):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    rows = queries.op2_url_filter(spark, folder).collect()
    assert sorted(r.page_id for r in rows) == sorted(urls)
    for r in rows:
        rule, verdict = plain_rule(urls[r.page_id], RULES)
        assert (r.host, r.path) == plain_parts(urls[r.page_id]) and r.rule == rule
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")


def test_clashing_columns_and_hosts_of_very_many_labels(spark):
    urls = [
        f"http://{'a.' * 100_000}net/x",
        f"http://{'.' * 100_000}example.com/de/",
        f"http://{'b.' * 50_000}example.org/en/",
        "http://a.example.net/en/",
        "http://c.com/",
    ]
    rows = [(k, u, "x", 1) for k, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, _host string, _rules int")
    pages = pages.withColumn("_rule_host", F.lit(0)).withColumn("url_host", F.lit("y"))
    judged, out = url_filter.judge(pages, RULES)
    assert judged.columns == [*pages.columns, out]
    got = {r.page_id: r[out] for r in judged.collect()}
    assert {k: r.rule for k, r in got.items()} == {k: plain_rule(u, RULES)[0] for k, u in enumerate(urls)}
    assert all(r.host == plain_parts(urls[k])[0] for k, r in got.items())
