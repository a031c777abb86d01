import json

import pytest
from pyspark.sql import functions as F

from textloom.operators import validation as V
from textloom.sources.sinks import envelope, split_status, write_split
from textloom.sources.texts import decode_requests, read_texts, text_lines


def test_key_errors(spark):
    rows = spark.createDataFrame(
        [
            (1, None, None), (2, "   ", "x" * 10), (3, "short", None), (4, " " * 12, "12345"),
            (5, "", "x" * 9 + " "),
        ],
        "i int, openai string, xai string",
    )
    errors = V.key_errors({"openai": F.col("openai"), "xai": F.col("xai")})
    got = {r.i: r.e for r in rows.select("i", errors.alias("e")).collect()}
    assert got == {
        1: ["At least one API key must be provided"],
        2: ["openai API key is empty"],
        3: ["openai API key appears to be too short"],
        4: ["openai API key is empty", "xai API key appears to be too short"],
        5: ["openai API key is empty"],
    }
    report = rows.select("i", V.error_report(errors).alias("r")).where("i = 4").first().r
    assert report == (
        "Configuration validation failed:\n- openai API key is empty\n"
        "- xai API key appears to be too short"
    )
    valid = spark.createDataFrame([("x" * 10, None)], "openai string, xai string")
    assert valid.select(V.error_report(errors)).first()[0] is None


def test_unpivot_keys(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "", "b")], "i int, o string, x string")
    got = V.unpivot_keys(rows, ["i"], {"openai": "o", "xai": "x"})
    assert sorted(map(tuple, got.collect())) == [
        (1, "openai", "a"), (2, "openai", ""), (2, "xai", "b")
    ]


BODIES = [
    ("{broken", "", "", "", 400, "model is required"),
    ("{}", "", "", "", 400, "model is required"),
    (None, "", "", "", 400, "model is required"),
    ("{'model': 'm/a', 'task_key': '3', 'text': 'x'}", "", "", "", 400, "model is required"),
    ('{"model": "m/a", "task_key": "3", "text": "x"} junk', "", "", "", 400, "model is required"),
    ('{"model": "m/a"}] x [', "", "", "", 400, "model is required"),
    ('{"model": "m/a"}, {"model": "m/b"}', "", "", "", 400, "model is required"),
    (' {"model": "m/a", "task_key": "3", "text": "a\\"b"} \n', "m/a", "3", 'a"b', 200, None),
    ('{"model": " m/a ", "task_key": "7"}', "m/a", "7", "", 400,
     "task_key must be one of ['1', '2', '3']"),
    ('{"model": "m/b", "task_key": " 1\\t", "text": " \\n"}', "m/b", "1", "", 400,
     "text is required"),
    ('{"model": "m/b", "task_key": "1", "text": " x "}', "m/b", "1", "x", 400,
     "Unknown model: m/b"),
    ('{"model": "m/a", "task_key": "3", "text": "x", "more": 1}', "m/a", "3", "x", 200, None),
    ('{"model": null, "task_key": "9", "text": ""}', "", "9", "", 400, "model is required"),
]


def test_requests(spark):
    rows = spark.createDataFrame([(i, b[0]) for i, b in enumerate(BODIES)], "i int, body string")
    models = spark.createDataFrame([("m/a",), ("m/a",)], "model_key string")
    got = V.check_requests(decode_requests(rows), models).orderBy("i").collect()
    assert [(r.body, r.model, r.task_key, r.text, r.http_code, r.error) for r in got] == BODIES


ERRORS = [
    ("processing", "refine", "boom", "Processing error in task 'refine': boom", "error"),
    ("model_init", "m", "boom 429", "Failed to initialize model 'm': boom 429", "error"),
    ("api", "xai", "boom", "API error with xai: boom", "error"),
    ("quota", "", "boom", "Google API quota exceeded. Please wait and try again, "
     "or select a different model.", "warning"),
    ("other", "", "id 14290", "API rate limit or quota exceeded. Please wait and try again, "
     "or select a different model.", "warning"),
    ("other", "", "RATE_limit_Exceeded", "API rate limit or quota exceeded. Please wait and try "
     "again, or select a different model.", "warning"),
    ("other", "", "boom", "An unexpected error occurred: boom", "warning"),
]


def test_triage(spark):
    rows = spark.createDataFrame(
        [(i, *e[:3]) for i, e in enumerate(ERRORS)], "i int, kind string, tag string, message string"
    )
    kind, tag, message = F.col("kind"), F.col("tag"), F.col("message")
    got = rows.orderBy("i").select(V.friendly_message(kind, tag, message), V.severity(kind)).collect()
    assert [tuple(r) for r in got] == [e[3:] for e in ERRORS]


def test_log_and_console(spark):
    row = spark.createDataFrame([("c", "", None, "m")], "c string, e string, n string, m string")
    lines = row.select(*[V.log_line(F.col(x), F.col("m")) for x in "cen"]).first()
    assert tuple(lines) == ("c: m", "m", "m")
    shown = row.select(
        V.console_message(F.lit("refine"), F.col("m")),
        V.console_message(F.lit("refine"), F.col("m"), F.lit(False)),
    ).first()
    assert tuple(shown) == (
        "Error: Processing error in task 'refine': m",
        "Unexpected error: An unexpected error occurred: m",
    )


def test_envelope(spark):
    rows = spark.createDataFrame(
        [("r \"q\" 汉", None), (None, "bad"), (None, None)], "r string, e string"
    )
    out = rows.select(envelope(F.col("r"), F.col("e"), F.lit("m/a"), F.lit("Refine"))).collect()
    assert [json.loads(r[0]) for r in out] == [
        {"ok": True, "result": 'r "q" 汉', "model": "m/a", "task": "Refine"},
        {"ok": False, "error": "bad"},
        {"ok": True, "result": None, "model": "m/a", "task": "Refine"},
    ]
    assert "汉" in out[0][0]


@pytest.mark.parametrize("format", ["parquet", "json", "orc", "csv"])
def test_read_texts(spark, tmp_path, format):
    path = str(tmp_path / format)
    rows = spark.createDataFrame([(1, "  a b "), (2, "　 "), (3, None)], "i int, text string")
    rows.write.format(format).option("header", "true").save(path)
    options = {"header": "true"} if format == "csv" else {}
    assert [r.text for r in read_texts(spark, path, format, **options).collect()] == ["a b"]


def test_read_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\n two \n")
    lines = read_texts(spark, str(tmp_path), "text")
    assert sorted(r.text for r in lines.collect()) == ["one", "two"]
    whole = read_texts(spark, str(tmp_path), "text", wholetext="true")
    assert [r.text for r in whole.collect()] == ["one\n\n two"]
    numbered = text_lines(whole)
    assert [(r.line_no, r.line) for r in numbered.collect()] == [(0, "one"), (1, ""), (2, " two")]


def test_split(spark, tmp_path):
    rows = spark.createDataFrame([(1, "ok"), (2, "failed"), (3, "ok")], "i int, status string")
    good, bad = split_status(rows)
    assert (good.count(), bad.count()) == (2, 1)
    path = str(tmp_path / "out")
    write_split(rows, path)
    assert spark.read.parquet(f"{path}/status=failed").collect()[0].i == 2


def test_bodies_and_fields_of_other_types(spark):
    """Each has one defined outcome, and none ends the job."""
    bodies = {
        '{"model": "m", "task_key": 1, "text": "t"}': ("m", "1", "t"),
        '{"model": null, "task_key": true, "text": 1.50}': ("", "true", "1.5"),
        '{"model": [1, 2], "task_key": {"a": null}, "text": " \\u3000x "}': ("[1,2]", '{"a":null}', "x"),
        '{"model": "a", "model": "b", "text": "\\u0041"}': ("b", "", "A"),
        '["m", "1", "t"]': ("", "", ""),
        '[{"model": "m"}]': ("", "", ""),
        "5": ("", "", ""),
        '"text"': ("", "", ""),
        "null": ("", "", ""),
        "{}": ("", "", ""),
        "": ("", "", ""),
        '{"model": "m"} {"model": "n"}': ("", "", ""),
        "{'model': 'm'}": ("", "", ""),
        '{"model": "m"': ("", "", ""),
        None: ("", "", ""),
    }
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    got = {r.body: (r.model, r.task_key, r.text) for r in decode_requests(df).collect()}
    assert got == bodies
