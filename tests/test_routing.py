import json
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom import fixed
from textloom.operators import langid
from textloom.operators.routing import (
    chosen_confidence,
    confidence,
    confidences,
    detected,
    direction,
    script_language,
)
from textloom.plans import requests as requests_plan
from textloom.plans.tasks import execute, prepare
from textloom.plans.templates import TEMPLATES, template_table


def by_hand(text, lang):
    """Base, up to 0.2 for length, up to 0.1 for the script or for common words."""
    text = text.strip()
    if not text or lang in (None, "unknown"):
        return 0.0
    bonus = 0.0
    if lang.startswith("zh"):
        bonus = min(len([c for c in text if "一" <= c <= chr(0x9FFF)]) / len(text), 0.1)
    elif lang == "en":
        words = text.lower().split()
        bonus = min(sum(w in words for w in fixed.COMMON_ENGLISH_WORDS) / 10, 0.1)
    return min(0.7 + min(len(text) / 100, 0.2) + bonus, 1.0)


TEXTS = [
    ("The cat", "en"), ("cat the", "en"), ("cat", "en"), ("theory of", "en"), ("theory, ofx", "en"),
    ("a" * 19, "en"), ("a" * 20, "en"), ("a" * 21, "en"), ("IT　IS\x1cthat", "en"),
    ("汉字" * 30, "zh-cn"), ("汉" + "a" * 30, "zh"), ("汉" + "a" * 3, "zh-tw"), ("abc", "zh"),
    ("le chat", "fr"), ("  ", "en"), ("", "unknown"), ("x", "unknown"), ("x", None), ("x the\n", "en"),
]


def test_confidence(spark):
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(TEXTS)], "i int, t string, l string")
    got = rows.orderBy("i").select(
        confidence(F.col("t"), F.col("l")), chosen_confidence(confidences(F.col("t")), F.col("l"))
    )
    got = got.collect()
    assert [r[0] for r in got] == [by_hand(*t) for t in TEXTS]
    assert [r[1] for r in got] == [r[0] for r in got]


def test_confidence_counts_words_when_one_is_not_enough(spark, monkeypatch):
    monkeypatch.setattr(fixed, "MAX_PATTERN_BONUS", 0.15)
    row = spark.createDataFrame([("the the and",)], "t string")
    assert row.select(confidence(F.col("t"), F.lit("en"))).first()[0] == 0.7 + 0.11 + 0.15
    monkeypatch.setattr(fixed, "WORDS_DIVISOR", 20)
    assert row.select(confidence(F.col("t"), F.lit("en"))).first()[0] == 0.7 + 0.11 + 0.1


def test_directions(spark):
    langs = ["zh", "zh-cn", "zh-tw", "en", "fr", "unknown"]
    rows = spark.createDataFrame([(x,) for x in langs], "lang string")
    got = {r.lang: tuple(r)[1:] for r in direction(rows, F.col("lang")).collect()}
    chinese = ("Chinese", "English", "zh_to_en")
    assert got == {
        "zh": chinese, "zh-cn": chinese, "zh-tw": chinese,
        "en": ("English", "Simplified Chinese", "en_to_zh"),
        "fr": ("Unknown (fr)", "Refined Text", "refine"),
        "unknown": ("Unknown (unknown)", "Refined Text", "refine"),
    }


def test_detected_and_script(spark):
    rows = spark.createDataFrame(
        [(1, "x", "en"), (2, " \n", "en"), (3, "x", None), (4, "汉字ab", "fr")], "i int, t string, l string"
    )
    got = rows.orderBy("i").select(
        detected(F.col("t"), F.col("l")), script_language(F.col("t"), F.col("l"))
    ).collect()
    assert [tuple(r) for r in got] == [
        ("en", "en"), ("unknown", "en"), ("unknown", None), ("fr", "zh-cn")
    ]


def by_letter(word):
    padded = f" {word} "
    return sorted(
        g for i in range(1, len(word) + 1) for g in (padded[i], padded[i : i + 2], padded[i - 1 : i + 2])
    )


@pytest.mark.parametrize("length", [1, 2, 3, 255, 256, 257, 258, 511, 512, 513, 1000])
def test_grams(spark, monkeypatch, length):
    word = "".join(chr(ord("a") + (i * i) % 26) if i % 5 else "汉" for i in range(length))
    texts = spark.createDataFrame([(f"{word}, 12 x",)], "t string")
    got = sorted(r.gram for r in langid.grams(langid.words(texts, F.col("t"))).collect())
    assert got == sorted(by_letter(word) + by_letter("x"))
    monkeypatch.setattr(langid, "RUN", 200)
    letters = texts.select(langid._letters(F.col("t"))).first()[0]
    keys = [k for part in langid._keys(letters) for k in part.tolist()]
    assert sorted(map(langid._gram, keys)) == got and [langid._key(g) for g in map(langid._gram, keys)] == keys
    monkeypatch.setattr(langid, "HELD", 100)
    taught = spark.createDataFrame([(word, "a"), ("x " + word, "b"), ("", "c")], "text string, lang string")
    counted = langid.fit(taught.coalesce(1)).table
    assert counted.where("lang = 'a'").count() == len(set(by_letter(word)))


def scores(taught, text):
    """Log-probability of every gram of a text in every language, in millionths."""
    counts = {}
    for row in taught.where("lang is not null").collect():
        for word in row.text.split():
            for gram in by_letter(word):
                counts.setdefault(row.lang, Counter())[gram] += 1
    size = len(set().union(*counts.values()))
    return {
        lang: [
            round(math.log((c[g] + 1) / (sum(c.values()) + size)) * 1_000_000)
            for word in text.split()
            for g in by_letter(word)
        ]
        for lang, c in counts.items()
    }


@pytest.mark.parametrize("limits", [(langid.PROFILE_ROWS, 1 << 20), (langid.PROFILE_ROWS, 0), (2, 0)])
def test_langid(spark, monkeypatch, limits):
    monkeypatch.setattr(langid, "PROFILE_ROWS", limits[0])
    monkeypatch.setattr(langid, "PROFILE_GAINS", limits[1])
    taught = spark.createDataFrame(
        [("the cat and the dog", "en"), ("der hund und die katze", "de"), ("今天天气很好", "zh"),
         ("no label", None)],
        "text string, lang string",
    )
    profile = langid.fit(taught)
    assert profile.languages == ["de", "en", "zh"]
    texts = spark.createDataFrame(
        [(1, "the dog"), (2, "die Katze!"), (3, "今天很好"), (4, "12 34"), (5, " "), (6, "qqq")],
        "i int, text string",
    )
    rows = langid.detect(texts, profile, "i").collect()
    assert next(r.log_score for r in rows if r.i == 1) == sum(
        scores(taught, "the dog")["en"]
    )
    got = {r.i: r.detected for r in rows}
    assert [got[i] for i in (1, 2, 3, 4, 5)] == ["en", "de", "zh", "unknown", "unknown"]
    assert got[6] in profile.languages


def test_many_languages(spark):
    """Each of 600 languages has a letter of its own."""
    taught = [(chr(0x4E00 + k) * 3 + " ab", f"l{k:03d}") for k in range(600)]
    profile = langid.fit(spark.createDataFrame(taught, "text string, lang string"))
    assert len(profile.languages) == 600
    texts = [(k, chr(0x4E00 + k)) for k in range(0, 600, 37)] + [(1000, "zzz")]
    found = langid.detect(spark.createDataFrame(texts, "i int, text string"), profile, "i")
    got = {r.i: r.detected for r in found.collect()}
    assert got.pop(1000) == "l000"  # all languages are alike for it
    assert got == {k: f"l{k:03d}" for k in got}


def test_five_thousand_languages(spark, monkeypatch):
    """Plans are no wider than for two languages, and both ways to score agree."""
    taught = [(f"{chr(0x4E00 + k)}{chr(0x4E00 + k // 3)} ab{k % 7}", f"l{k:04d}") for k in range(5000)]
    profile = langid.fit(spark.createDataFrame(taught, "text string, lang string"))
    few = langid.fit(spark.createDataFrame(taught[:2], "text string, lang string"))
    texts = [(k, f"ab {chr(0x4E00 + 250 * k)} {chr(0x4E00 + 83 * k)}") for k in range(20)] + [(3, "x"), (None, "ab")]
    df = spark.createDataFrame(texts, "i int, text string")
    rows, widths = [], []
    for gains in (1 << 40, 0):
        monkeypatch.setattr(langid, "PROFILE_GAINS", gains)
        monkeypatch.setattr(langid, "RUN", 5)
        found = langid.scores(df, profile, "i")
        rows.append({r.i: [tuple(x) for x in r.scores] for r in found.collect()})
        plans = [langid.scores(df, p, "i")._jdf.queryExecution().analyzed().toString() for p in (profile, few)]
        widths.append([len(p.splitlines()) for p in plans])
        assert max(map(len, plans[0].splitlines())) < 3000
    assert rows[0] == rows[1] and len(rows[0]) == 21 and all(len(x) == 5000 for x in rows[0].values())
    assert widths[0][0] == widths[0][1] and widths[1][0] == widths[1][1]


def test_probabilities(spark, folder):
    """On texts that were not learned from, the probability says how often the language is right."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    # A few words of each text, so that some are hard to tell
    words = F.concat_ws(" ", F.slice(F.split("text", " "), 1 + F.col("doc_id").cast("int") % 3, 1))
    short = docs.withColumn("text", words)
    profile = langid.fit(short.where("doc_id % 3 = 0"))
    held = short.where("doc_id % 3 = 1")
    temperature = langid.fit_temperature(held, profile, "doc_id")
    assert temperature in langid.TEMPERATURES
    told = langid.detect(short.where("doc_id % 3 = 2"), profile, "doc_id", temperature=temperature).collect()
    assert all(0 <= r.probability <= 1 for r in told)
    unknown = [r.probability for r in told if r.detected == "unknown"]
    assert set(unknown) <= {0.0}
    said = sum(r.probability for r in told) / len(told)
    right = sum(r.detected == r.lang for r in told) / len(told)
    assert abs(said - right) < 0.12
    # By brute force: no other temperature makes the true languages more probable.
    known = {r.doc_id: r.lang for r in held.collect()}
    rows = langid.scores(held, profile, "doc_id").collect()

    def loss(t):
        total = 0.0
        for r in rows:
            by_lang = {profile.languages[-x.place]: x.s / t for x in r.scores}
            top = max(by_lang.values())
            if known[r.doc_id] in by_lang:
                total += math.log(sum(math.exp(v - top) for v in by_lang.values())) + top - by_lang[known[r.doc_id]]
        return total

    assert temperature == min(langid.TEMPERATURES, key=loss)
    nothing = langid.detect(held, profile, "doc_id", temperature=1e6).where("false")
    assert nothing.columns[-2:] == ["log_score", "probability"]


def test_langid_without_languages(spark):
    nothing = langid.fit(spark.createDataFrame([("x", None)], "text string, lang string"))
    texts = spark.createDataFrame([(1, "the dog")], "i int, text string")
    assert langid.detect(texts, nothing, "i").first().detected == "unknown"


REQUESTS = [
    (1, "m/a", "refine", "x {y}", "en", None, "refine"),
    (2, "m/a", "auto_translate", "x", "en", None, "en_to_zh"),
    (3, "m/a", "auto_translate", "x", "zh-tw", None, "zh_to_en"),
    (4, "m/a", "auto_translate", "x", "fr", None, "refine"),
    (5, "m/a", "sing", "x", "en", "Prompt for task 'sing' not found", "sing"),
    (6, "m/z", "sing", "x", "en", "Model 'm/z' not found", "sing"),
    (7, None, "refine", "x", "en", "No model selected", "refine"),
    (8, "m/a", None, "x", "en", "No task selected", None),
    (9, "", None, "x", "en", "No model selected", None),
]


@pytest.fixture(scope="module")
def requests(spark):
    return spark.createDataFrame(
        [r[:5] for r in REQUESTS], "i int, model_key string, task_id string, text string, lang string"
    )


@pytest.fixture(scope="module")
def models(spark):
    return spark.createDataFrame([("m/a",), ("m/b",)], "model_key string")


def test_prepare(spark, requests, models):
    got = prepare(requests, template_table(spark), models).orderBy("i").collect()
    forms = dict(TEMPLATES)
    for row, (_, _, _, text, _, error, task) in zip(got, REQUESTS):
        assert (row.error, row.prompt_task) == (error, task)
        assert row.prompt == (None if error else forms[task].replace("{user_text}", text))


def test_empty_template_counts_as_missing(spark, requests):
    got = prepare(requests.where("i = 1"), template_table(spark, [("refine", "")])).first()
    assert got.error == "Prompt for task 'refine' not found"


def test_execute(spark, requests, models):
    def factory(name):
        def run(prompt):
            if "In Chinese" in prompt:
                raise ValueError("rate_limit_exceeded")
            return name + "!"

        return run

    prepared = prepare(requests.where("i < 7"), template_table(spark), models)
    got = {r.i: r for r in execute(prepared, factory).collect()}
    assert (got[1].result, got[1].is_error, got[1].message) == ("m/a!", False, "m/a!")
    assert got[2].error == fixed.MSG_RATE_LIMIT and got[2].result is None
    assert got[2].message == (
        "Error: Processing error in task 'auto_translate': " + fixed.MSG_RATE_LIMIT
    )
    assert got[6].message == "Error: Processing error in task 'sing': Model 'm/z' not found"
    assert got[6].attempts == 0


def test_answers(spark, models):
    def factory(name):
        def run(prompt):
            if "boom" in prompt:
                raise ValueError("boom")
            return name + "!"

        return run

    bodies = [
        '{"model": "m/a", "task_key": "1", "text": " hi "}',
        '{"model": "m/a", "task_key": "3", "text": "boom"}',
        '{"model": "m/z", "task_key": "1", "text": "boom"}',
        "{",
    ]
    rows = spark.createDataFrame(
        [(i, b, "en") for i, b in enumerate(bodies)], "i int, body string, lang string"
    )
    got = requests_plan.answer(rows, models, template_table(spark), factory).orderBy("i").collect()
    assert [(r.http_code, json.loads(r.answer)) for r in got] == [
        (200, {"ok": True, "result": "m/a!", "model": "m/a", "task": fixed.TASKS[0][2]}),
        (500, {"ok": False, "error": "An unexpected error occurred: boom"}),
        (400, {"ok": False, "error": "Unknown model: m/z"}),
        (400, {"ok": False, "error": "model is required"}),
    ]
    down = requests_plan.not_ready(rows, "no models").first()
    assert (down.http_code, json.loads(down.answer)) == (503, {"ok": False, "error": "no models"})
