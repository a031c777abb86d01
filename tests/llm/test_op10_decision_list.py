"""Counts against plain Python; learned lists on held-out rows; odd rows."""

import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import decision_lists, queries
from textloom.llm.statistics import FIELDS, statistics

WORD = r"[^\x20\x09-\x0D]+"


def plain_counts(text):
    text = text or ""
    words = re.findall(WORD, text)
    lines = [line for line in text.split("\n") if re.search(WORD, line)]
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = set()
    for k in range(len(words) - 2):
        if windows[tuple(words[k : k + 3])] > 1:
            inside |= {k, k + 1, k + 2}
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(inside)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("ab  \n\n\t\r\x0b\x1c é#*|<日")), max_size=80))
def test_counts(text):
    found = dict(zip(FIELDS, statistics(text.encode())))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert tuple(found[n] for n in names) == plain_counts(text)


def test_many_distinct_words_are_counted_exactly():
    words = [f"w{k}" for k in range((1 << 20) + 10)]
    text = " ".join([*words, "w5 w6 w7", "end"])
    found = dict(zip(FIELDS, statistics(text.encode())))
    assert found["n_repeat_words"] == 6 and found["n_distinct"] == len(words) + 1


def sample(n, seed):
    draw = np.random.default_rng(seed)
    rows = {"a": draw.random(n), "b": draw.random(n), "c": draw.random(n)}
    return rows, (rows["a"] > 0.7) & (rows["b"] <= 0.5) | (rows["c"] > 0.9)


def test_list_is_right_on_held_out_rows():
    rules = decision_lists.learn(*sample(4000, 1))
    rows, bad = sample(4000, 2)
    said = np.zeros(len(bad), bool)
    for rule in rules:
        said |= rule.holds(rows, len(bad))
    assert (said == bad).mean() > 0.97
    assert all(len(r.conditions) <= 4 and r.precision >= 0.95 for r in rules)
    assert [str(r) for r in rules] == [str(r) for r in decision_lists.learn(*sample(4000, 1))]


def test_nothing_to_learn_gives_an_empty_list():
    none = {"a": np.zeros(0)}
    assert decision_lists.learn(none, np.zeros(0, bool)) == []
    same = {"a": np.ones(50)}
    assert decision_lists.learn(same, np.arange(50) % 2 == 0) == []
    assert decision_lists.learn(same, np.ones(50, bool)) == []


def test_columns_follow_the_rules(spark):
    c = decision_lists.Condition
    rules = [
        decision_lists.Rule([c("symbol_share", True, 0.1)]),
        decision_lists.Rule([c("n_words", False, 60.0), c("upper_share", True, 0.5)]),
    ]
    texts = ["## " * 60, " ".join(f"W{k}" for k in range(55)).upper(), " ".join(f"w{k}" for k in range(80)), None, ""]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, judged string")
    found, out = decision_lists.judge(docs, rules)
    assert out != "judged" and found.count() == len(texts)
    got = {r.doc_id: (r[out].base_failed, r[out].rule, r[out].kept) for r in found.collect()}
    assert got[0] == (True, 0, False)
    assert got[1][2] is (got[1][1] is None)
    assert got[2] == (False, None, True)
    assert got[3] == got[4] == (True, None, False)


def test_odd_labels(spark):
    docs = spark.createDataFrame(
        [(1, "a b c"), (1, "a b c"), (None, "x"), (2, None)], "doc_id long, text string"
    )
    labels = spark.createDataFrame(
        [(1, 1), (1, 0), (2, None), (None, 0), (7, 1)], "doc_id long, quality int"
    )
    assert decision_lists.fit(docs, labels) == []
    assert decision_lists.fit(docs, labels.limit(0)) == []
    assert decision_lists.fit(docs.limit(0), labels) == []


def test_query(spark, folder):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.op10_decision_list(spark, folder).collect()
    assert len(rows) == len(docs)
    for r in rows:
        counts = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert counts == plain_counts(docs[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.rule is None)


def test_verdicts_on_held_out_labels(spark, folder):
    folder = folder.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rules = decision_lists.fit(docs, labels.filter("doc_id % 3 <> 0"))
    judged, out = decision_lists.judge(docs.join(labels.filter("doc_id % 3 = 0"), "doc_id"), rules)
    rows = judged.select("quality", f"{out}.kept", f"{out}.base_failed").filter("not base_failed").collect()
    assert sum(r.kept == (r.quality == 1) for r in rows) / len(rows) > 0.95
