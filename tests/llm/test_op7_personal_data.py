"""Personal data: base spans against plain Python, on texts made to be awkward."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from textloom.llm import personal_data, queries

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (2 if k % 2 else 1)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def holds(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 9 <= len(digits) <= 15


def plain_spans(text):
    found = [
        (m.start(), k, m.end(), kind)
        for k, (kind, pattern) in enumerate(PLAIN.items())
        for m in re.finditer(pattern, text or "")
        if holds(kind, m[0])
    ]
    return sorted(found)


def plain_row(i, text):
    spans = plain_spans(text)
    joined = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)
    counts = tuple(sum(s[3] == k for s in spans) for k in PLAIN)
    return (i, *counts, hashlib.sha256(joined.encode()).hexdigest())


def card(draw, n):
    body = "".join(draw.choice("0123456789") for _ in range(n - 1))
    return next(body + c for c in "0123456789" if luhn(body + c))


def awkward(n, seed):
    draw = random.Random(seed)
    parts = list("aZ09._%+-@ .\n()é日\U0001f600,:") + [
        "x@y.co", "a@b", "@", "1.2.3.4", "256.1.1.1", "001.02.3.255", "+1 (988) 555-2485", "+4", "12-34 56", "..", "--", "  ", "+1-2",
    ]
    out = []
    for _ in range(n):
        pieces = [draw.choice(parts) for _ in range(draw.randint(0, 14))]
        for size in draw.sample(range(11, 22), 1):
            number = card(draw, size)
            if draw.random() < 0.5:
                number = draw.choice([" ", "-"]).join(re.findall(".{1,4}", number))
            pieces.insert(draw.randint(0, len(pieces)), draw.choice(["", " ", "x"]) + number)
        out.append("".join(pieces))
    return out


def rows_of(found):
    names = ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    return sorted((tuple(r[n] for n in names) for r in found.collect()), key=repr)


def test_base_spans_of_awkward_texts(spark):
    texts = awkward(3000, 1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    assert sum(bool(plain_spans(t)) for t in texts) > 500
    assert rows_of(personal_data.digests(docs)) == sorted((plain_row(*r) for r in enumerate(texts)), key=repr)


def runs(n):
    return ["a" * n, "1" * n, "1." * (n // 2), "1 " * (n // 2), "+1" + "(" * n, "a.b-c" * (n // 5) + "@", "x@" * (n // 2), "é" * n + "q@w.de"]


def test_long_runs(spark):
    docs = spark.createDataFrame(list(enumerate(runs(4000))), "doc_id long, text string")
    want = sorted((plain_row(*r) for r in enumerate(runs(4000))), key=repr)
    assert rows_of(personal_data.digests(docs)) == want


def test_long_runs_take_linear_time(spark):
    """Plain forms would take hours over some of these."""
    docs = spark.createDataFrame(list(enumerate(runs(400_000))), "doc_id long, text string").repartition(8)
    found = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone) for r in personal_data.digests(docs).collect()}
    none = (0, 0, 0, 0)
    assert found == {k: none for k in (0, 1, 3, 4, 5, 6)} | {2: (0, 50_000, 0, 0), 7: (1, 0, 0, 0)}


def test_many_spans_in_a_text(spark):
    text = "me@my.org 10.0.0.1 " * 10_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert rows_of(personal_data.digests(docs)) == [plain_row(1, text)]


def test_running_sums(spark):
    for n in (0, 1, 2, 3, 10, 101):
        numbers = [k * 7 % 5 for k in range(n)]
        row = spark.createDataFrame([(numbers,)], "x array<bigint>").select(personal_data.running_sums(F.col("x"))).first()
        assert row[0] == [sum(numbers[: k + 1]) for k in range(n)]


def test_further_spans_need_checks_or_context(spark):
    texts = [
        "IBAN DE89 3704 0044 0532 0130 00 here",
        "IBAN DE88 3704 0044 0532 0130 00 here",
        "GB82WEST12345698765432",
        "call me: 212-555-0187 soon",
        "part number 212-555-0187 in stock",
        "my ssn is 078-05-1120.",
        "078-05-1120",
        "tel +1 212-555-0187",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.spans for r in personal_data.digests(docs).collect()}
    assert found == {
        0: "iban:5:32", 1: "", 2: "iban:0:22", 3: "phone:9:21", 4: "", 5: "ssn:10:21", 6: "", 7: "phone:4:19",
    }


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a@b.cd"), (3, "a@b.cd"), (3, "a@b.cd"), (4, "\U0001f600 a@b.cd_x@c.org")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, base_spans string, text_found int")
    assert rows_of(personal_data.digests(docs)) == sorted((plain_row(*r) for r in rows), key=repr)
    found, base, every = personal_data.find(docs)
    assert set(docs.columns) < set(found.columns) and found.count() == len(rows)
    assert personal_data.digests(docs.limit(0)).count() == 0


def test_the_plan_stays_in_the_jvm(spark, folder):
    plan = queries.op7_personal_data(spark, folder)._jdf.queryExecution().executedPlan().toString()
    for word in ("Python", "Arrow", "Pandas", "Exchange"):
        assert word not in plan


def test_query_against_plain_python(spark, folder):
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(queries.op7_personal_data(spark, folder)) == sorted((plain_row(*r) for r in docs), key=repr)


@pytest.mark.parametrize("value, right", [("DE89370400440532013000", True), ("DE89370400440532013001", False), ("GB82 WEST 1234 5698 7654 32", True)])
def test_mod97(spark, value, right):
    row = spark.createDataFrame([(value,)], "v string").select(personal_data.mod97(F.col("v"))).first()
    assert row[0] is right
