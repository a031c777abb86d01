import sys
from itertools import groupby

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from textloom import fixed
from textloom.functions import text as T

RELAXED = settings(
    max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)


def apply(spark, values, expression, kind="string"):
    """Results of an expression over column x, in the order of ``values``."""
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r[1] for r in rows.select("i", expression(F.col("x"))).orderBy("i").collect()]


def test_spaces_are_those_of_python():
    assert set(T.SPACES) == {chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace()}


@RELAXED
@given(st.lists(st.text(alphabet="ab \t\n\x1c\x85　 é", max_size=12), min_size=1))
def test_strip_and_tokens(spark, texts):
    assert apply(spark, texts, T.strip) == [t.strip() for t in texts]
    found = apply(spark, texts, lambda c: F.array_sort(T.tokens(c)))
    assert found == [sorted(set(t.lower().split())) for t in texts]


def test_blank(spark):
    assert apply(spark, ["", "   ", "x", None], T.is_blank) == [True, True, False, True]


def test_render_leaves_braces_and_holes_of_the_text(spark):
    texts = ['{"a": 1}', "{user_text}", "{", "a\nb", "$1 \\1"]
    out = apply(spark, texts, lambda c: T.render(F.lit("<{user_text}>"), c))
    assert out == [f"<{t}>" for t in texts]


def test_replace_all(spark):
    assert apply(spark, ["✅ a ⚠️ b ✅", "plain"], T.replace_all) == ["[OK] a [WARN] b [OK]", "plain"]


def test_char_share(spark):
    out = apply(spark, ["汉字ab", "abc", ""], T.char_share)
    assert out == [0.5, 0.0, None]


def test_cut_at_terminator(spark):
    texts = ["a\nb\n DONE!!! \nc", "no end\n", "done!!!\nx", " a \n\n done!!!", "say done!!! now"]
    assert apply(spark, texts, T.cut_at_terminator) == ["a\nb", "no end", "", "a", "say done!!! now"]


def test_names_and_keys(spark):
    keys = ["openai/gpt", "a/b/c", "plain", "/x"]
    assert apply(spark, keys, T.key_group) == ["openai", "a", "Unknown", ""]
    assert apply(spark, keys, lambda c: T.key_group(c, "Other"))[2] == "Other"
    assert apply(spark, keys, T.key_name) == ["gpt", "b/c", "plain", "x"]
    assert apply(spark, ["models/gemini", "x"], T.basename) == ["gemini", "x"]
    groups = ["openAI", "XAI", "xai", "two words", "éa"]
    assert apply(spark, groups, T.group_label) == ["Openai", "xAI", "xAI", "Two words", "Éa"]
    assert apply(spark, groups, T.group_label_web)[:2] == ["OpenAI", "XAI"]
    assert apply(spark, ["Refine (x) (y)", "Plain"], T.short_label) == ["Refine", "Plain"]
    shown = apply(spark, ["Name", "", None], lambda c: T.display_name(c, F.lit("id")))
    assert shown == ["Name", "id", "id"]


def natural(text):
    """Runs of digits as numbers, everything between them as text."""
    key = []
    for is_number, run in groupby(text.lower(), key=str.isdecimal):
        run = "".join(run)
        if is_number and not key:
            key.append("")
        key.append(int(run) if is_number else run)
    if key and isinstance(key[-1], int):
        key.append("")
    return key or [""]


@RELAXED
@given(st.lists(st.text(alphabet="aB-.019٣２", max_size=8), min_size=2, max_size=30))
def test_natural_order(spark, ids):
    rows = spark.createDataFrame([(i,) for i in ids], "x string")
    got = [r.x for r in rows.orderBy(T.natural_key(F.col("x")), "x").collect()]
    assert got == sorted(ids, key=lambda t: (natural(t), t))


def test_natural_order_of_long_numbers(spark):
    big = ["m-" + "9" * 50, "m-1" + "0" * 50, "m-120b", "m-20b", "m-3.3", "m-3.1", "m-003.2"]
    rows = spark.createDataFrame([(i,) for i in big], "x string")
    got = [r.x for r in rows.orderBy(T.natural_key(F.col("x")), "x").collect()]
    assert got == ["m-3.1", "m-003.2", "m-3.3", "m-20b", "m-120b", big[0], big[1]]


def test_keywords(spark):
    ids = ["my-Device", "GPT-Image", "gpt-4o", "search-DEV"]
    first = apply(spark, ids, lambda c: T.first_keyword(c, ["image", "dev", "search"]))
    assert first == ["dev", "image", None, "dev"]
    found = apply(spark, ids, lambda c: T.has_any(c, ["image", "dev", "search"]))
    assert found == [True, True, False, True]
    special = apply(spark, ["a.b", "axb"], lambda c: T.has_any(c, [".", "["]))
    assert special == [True, False]


@pytest.mark.parametrize("keyword", fixed.NON_TEXT_KEYWORDS)
def test_keyword_lists_are_lower_case(keyword):
    assert keyword == keyword.lower()


def test_prefix_and_capability(spark):
    ids = ["Gemini-1.0-pro", "gemini-2.5", "x-gemini-1.0-"]
    assert apply(spark, ids, lambda c: T.starts_with_any(c, ["gemini-1.0-"])) == [True, False, False]
    lists = [None, [], ["a"], ["b", "a"], ["b", None]]
    found = apply(spark, lists, lambda c: T.null_or_contains(c, "a"), "array<string>")
    assert found == [True, False, True, True, False]


def test_snapshot_parts(spark):
    ids = [
        "m-2024-05-13", "m-1106", "m-0125-preview", "m-20241022", "m-0125-Preview", "m",
        "m-1106\n", "m-1106\r", "m-١١٠٦", "m-1106-2024-01-02-x",
    ]
    dates = apply(spark, ids, T.snapshot_date)
    assert dates == ["2024-05-13", "1106", "0125", "", "", "", "1106", "", "١١٠٦", "2024-01-02"]
    bases = apply(spark, ids, T.snapshot_base)
    assert bases == [
        "m", "m", "m", "m-20241022", "m-0125-Preview", "m", "m", "m-1106\r", "m", "m-1106"
    ]


def test_elapsed_seconds(spark):
    row = spark.sql(
        "select timestamp_ntz'2024-01-01 00:00:00' a, timestamp_ntz'2024-01-01 00:01:00.26' b"
    )
    assert row.select(T.elapsed_seconds(F.col("a"), F.col("b"))).first()[0] == 60.3


def test_fill(spark):
    out = apply(spark, ["v", "{x}"], lambda c: T.fill("a '{x}' {y} b", x=c))
    assert out == ["a 'v' {y} b", "a '{x}' {y} b"]
