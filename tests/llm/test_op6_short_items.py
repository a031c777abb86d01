"""Short benchmark items, items without an id, and texts that repeat a piece over and over."""

import random
import re
import time
import tracemalloc

import pytest
from test_op6_decontamination import words

from textloom.llm import decontamination as d


def plain(item, text):
    """Places of a short item by a search at every place."""
    inside = lambda a, b: a.isalnum() and b.isalnum() and max(a, b) < "฀"
    ends = lambda t, k: not inside(t[k - 1 : k], t[k : k + 1])
    n = len(item)
    return [(k, k + n) for k in range(len(text) - n + 1) if text[k : k + n] == item and ends(text, k) and ends(text, k + n)]


def test_short_items_against_a_search_at_every_place():
    draw = random.Random(1)
    letters = "ab1 é日-"
    strip = lambda t: re.sub(" +", " ", t).strip()
    items = {strip("".join(draw.choice(letters) for _ in range(draw.randint(1, 14)))) for _ in range(300)} - {""}
    items = list(enumerate(sorted(items)))
    index = d.build([(k, t.encode()) for k, t in items])
    texts = [strip("".join(draw.choice(letters) for _ in range(draw.randint(0, 80)))) for _ in range(100)]
    texts += [f"x {t} y" for _, t in items] + ["", "a"]
    found = d.search(index, [t.encode() for t in texts])
    for text, own in zip(texts, found):
        got = {(f["item_id"], f["start"], f["stop"], f["edits"]) for f in own if f["windows"] == 1}
        want = {(k, a, b, 0) for k, t in items for a, b in plain(t, text)}
        # Places of one item that overlap are one finding.
        assert got <= want and {f["item_id"] for f in own} == {w[0] for w in want}
        assert sum(f["windows"] for f in own) == len(want)


def test_short_items_and_items_without_an_id_are_found(spark):
    draw = random.Random(2)
    brief, long = "What is the capital of Atlantis", words(draw, 30)
    rows = [(1, f"{words(draw, 20)}\n{brief.upper()}? {words(draw, 20)}"), (2, f"{words(draw, 9)} {long}"), (3, f"{brief}an {words(draw, 5)}"), (4, brief)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, brief), (None, long), (None, None), (8, " \t")], "item_id long, text string")
    found = {(r.doc_id, r.item_id, r.edits) for r in d.contaminations(docs, bench).collect()}
    assert found == {(1, 7, 0), (2, None, 0), (4, 7, 0)}
    assert [r.doc_id for r in d.clean(docs, bench).collect()] == [3]
    assert {r.doc_id for r in d.contaminations(docs, bench, least_bytes=32).collect()} == {2}


@pytest.mark.parametrize("piece", ["-", "+-", "+---", "| a bc ", "0123456789abcdefghij" * 3])
def test_repeated_pieces_take_bounded_time_and_memory(piece):
    draw = random.Random(3)
    item = (piece * 400)[:400]
    other = f"{words(draw, 12)} {item} {words(draw, 12)}"
    index = d.build([(1, item.encode()), (2, other.encode())])
    lone = (piece * 200_000)[:200_000]
    texts = [lone, f"{words(draw, 30)} {other} {words(draw, 30)}", words(draw, 50), f"{words(draw, 30)} {lone} {other}"]
    tracemalloc.start()
    began = time.monotonic()
    found = [{f["item_id"] for f in own} for own in d.search(index, [t.encode() for t in texts])]
    took, most = time.monotonic() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 1 in found[0] and found[1] == found[3] == {1, 2} and found[2] == set()
    assert took < 20 and most < 100e6, (took, most)


def test_stretches_are_cut_alike_in_items_and_texts():
    draw = random.Random(4)
    for _ in range(50):
        piece = "".join(draw.choice("ab-|") for _ in range(draw.randint(1, 9)))
        item = f"{words(draw, 8)} {piece * draw.randint(1, 60)} {words(draw, 8)}"
        index = d.build([(5, item.encode())])
        text = f"{words(draw, 20)} {item} {words(draw, 20)}"
        (own,) = d.search(index, [text.encode()])
        assert [f["edits"] for f in own] == [0]
        assert text[own[0]["start"] : own[0]["stop"]].strip() == item


def test_halves_give_what_the_whole_gives(monkeypatch):
    draw = random.Random(5)
    lead = words(draw, 12)
    items = [(k, f"{lead} {words(draw, 15)}".encode()) for k in range(40)]
    index = d.build(items)
    texts = [words(draw, 200), " ".join(f"{words(draw, draw.randint(1, 40))} {t.decode()}" for _, t in items), lead * 20]
    texts = [t.encode() for t in texts]
    whole = d.search(index, texts)
    monkeypatch.setattr(d, "HITS", 100)
    assert d.search(index, texts) == whole and {f["item_id"] for f in whole[1]} == set(range(40))


def test_edits_beyond_the_lemma_are_refused():
    with pytest.raises(ValueError):
        d.build([(1, b"x" * 50)], edits=0.1)
