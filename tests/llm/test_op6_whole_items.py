"""Benchmark items with white space of their own, short ones and ones without an id."""

import random
import re

import pytest
from test_op6_decontamination import words

from textloom.llm import decontamination as d

CODE = """def total(rows):\r
    found = 0\r
\r
    for row in rows:\r
        if row.kept:\r
            found   +=   row.size\r
        else:\r
            found   -=   row.lost\r
\r
    return found\r
"""


def test_copies_with_white_space_of_their_own(spark):
    draw = random.Random(1)
    item = words(draw, 40)
    wrapped = item.replace(" ", "\n        ")
    rows = [(1, f"{words(draw, 50)}\n\n{CODE}"), (2, f"{words(draw, 9)}:   \t{wrapped}"), (3, words(draw, 60)), (4, CODE.replace("\r\n", " ") + "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, CODE), (2, item)], "item_id long, text string")
    found = {r.doc_id: r for r in d.contaminations(docs, bench).collect()}
    assert {i: r.item_id for i, r in found.items()} == {1: 1, 2: 2, 4: 1}
    assert all(r.edits == 0 for r in found.values())
    texts = dict(rows)
    assert texts[1][found[1].start : found[1].stop] == CODE.strip()
    assert texts[2][found[2].start : found[2].stop] == wrapped
    assert [r.doc_id for r in d.clean(docs, bench).collect()] == [3]


@pytest.mark.parametrize("texts", [[b""], [b"", b" \t", b"a \r\n b", b"\0 \0"], [b"  x  ", b"y"]])
def test_places_before_runs_were_cut(texts):
    data, places, starts = d.joined(texts)
    whole = b"\0".join(map(d.normal, texts)) + b"\0"
    assert len(data) == len(places) and all(whole[k] == c for k, c in zip(places, data))
    assert data.split(b"\0")[:-1] == [re.sub(b" +", b" ", d.normal(t)) for t in texts]
    assert [whole[s : s + len(t)] for s, t in zip(starts, texts)] == [d.normal(t) for t in texts]
