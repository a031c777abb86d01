"""Decontamination: alignment and findings against brute force, planted passages, odd rows."""

import random

import numpy as np
import pytest

from textloom.llm import decontamination as d
from textloom.llm import queries


def words(draw, n):
    return " ".join("".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(2, 9))) for _ in range(n))


def edited(draw, text, n):
    chars = list(text)
    for _ in range(n):
        k = draw.randrange(len(chars))
        kind = draw.randrange(3)
        if kind == 0:
            chars[k] = "z"
        elif kind == 1:
            chars.insert(k, "y")
        else:
            del chars[k]
    return "".join(chars)


def least_edits(window, text):
    """Edits of a window at the best place of a text, by the full table."""
    row = [0] * (len(text) + 1)
    for k, c in enumerate(window, 1):
        new = [k]
        for j, x in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != x), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_alignment():
    draw = random.Random(2)
    for _ in range(200):
        window = bytes(draw.choice(b"abc") for _ in range(draw.randint(1, 25)))
        text = bytes(draw.choice(b"abc") for _ in range(draw.randint(0, 40)))
        want = least_edits(window, text)
        got = d.align(window, text, -30, 45, len(window))
        assert got is not None and got[0] == want
        if want:
            assert d.align(window, text, -30, 45, want - 1) is None


def test_every_window_within_its_edits_is_found():
    draw = random.Random(3)
    items = [(k, words(draw, draw.randint(9, 60)).encode()) for k in range(60)]
    index = d.build(items)
    for _ in range(300):
        k = draw.randrange(len(items))
        item = items[k][1].decode()
        low, high = draw.choice(d.windows(len(item)))
        part = edited(draw, item[low:high], int(d.EDITS * (high - low)))
        text = f"{words(draw, draw.randint(0, 200))}{part}{words(draw, draw.randint(0, 200))}"
        found = d.search(index, [b"first text", text.encode(), b""])
        assert found[0] == found[2] == []
        assert k in {f["item_id"] for f in found[1]}


def test_bound_is_that_of_the_lemma():
    assert d.needed(128, 0.06) == 128 + 1 - 12 * 8
    assert d.windows(300) == [(0, 128), (64, 192), (128, 256), (172, 300)]


def test_clean_texts_stay_clean():
    draw = random.Random(4)
    index = d.build([(k, words(draw, 40).encode()) for k in range(100)])
    assert not any(d.search(index, [words(draw, 300).encode() for _ in range(50)]))


def test_places_are_code_points_of_the_text():
    item = "der schöne lange prüfungssatz, über den niemand spricht, größer als gedacht"
    text = f"日本 É {item.upper().replace('Ö', 'ö').replace('Ü', 'ü').replace('SS', 'ss')} ß."
    index = d.build([(7, item.encode())])
    (found,) = d.search(index, [text.encode()])[0:1]
    assert len(found) == 1 and found[0]["item_id"] == 7
    start = text.index("DER") if "DER" in text else 0
    assert abs(found[0]["start"] - start) <= 4 and abs(found[0]["stop"] - (start + len(item))) <= 4


def test_copies_in_neighbouring_texts_are_kept_apart():
    item = words(random.Random(5), 30)
    index = d.build([(1, item.encode())])
    found = d.search(index, [item.encode(), item.encode(), b"", item.encode()])
    assert [len(f) for f in found] == [1, 1, 0, 1]
    assert all((f[0]["start"], f[0]["stop"]) == (0, len(item)) for f in found if f)


def corpus(draw, n=60):
    items = [(k, words(draw, 25)) for k in range(12)]
    docs, leaks = [], set()
    for k in range(n):
        text = words(draw, 80)
        if k % 7 == 0:
            item = draw.choice(items)
            text = f"{text} {edited(draw, item[1], 3)}\n{words(draw, 30)}"
            leaks.add((k, item[0]))
        docs.append((k, text))
    return docs, items, leaks


@pytest.mark.parametrize("size", [200, 1 << 20])
def test_planted_passages(spark, size):
    docs, items, leaks = corpus(random.Random(6))
    docs_table = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = d.contaminations(docs_table, bench, index_bytes=size).collect()
    assert {(r.doc_id, r.item_id) for r in found} == leaks
    kept = d.clean(docs_table, bench, index_bytes=size)
    assert {r.doc_id for r in kept.collect()} == {k for k, _ in docs} - {k for k, _ in leaks}


def test_odd_rows(spark):
    item = words(random.Random(8), 30)
    rows = [(1, item), (1, item), (None, item), (2, None), (3, ""), (4, f"a\0b {item.upper()}\t\n"), (5, "la " * 200_000), (6, item[:30])]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, items_found string, item_id int")
    bench = spark.createDataFrame(
        [(1, item, 0), (1, item, 0), (None, item, 0), (2, None, 0), (3, "", 0), (4, "short", 0), (5, item, 0)],
        "item_id long, text string, doc_id int",
    )
    found = [(r.doc_id, r.item_id) for r in d.contaminations(docs, bench).collect()]
    assert sorted(found, key=repr) == sorted([(i, k) for i in (1, 1, None, 4) for k in (None, 1, 5)], key=repr)
    kept = d.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 5, 6]
    assert d.contaminations(docs.limit(0), bench).count() == 0
    assert d.contaminations(docs, bench.limit(0)).count() == 0
    assert d.clean(docs, bench.limit(0)).count() == len(rows)


def test_query_finds_what_a_search_for_whole_items_finds(spark, folder):
    flat = lambda t: " ".join(t.lower().split())
    items = [flat(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    want = {r.doc_id for r in docs if any(i in flat(r.text) for i in items)}
    found = {r.doc_id for r in queries.op6_decontamination(spark, folder).collect()}
    assert want and found == want


def test_numbers_of_grams():
    data = b"abcdefghijklmnopqrstuvwxyz" * 2
    grams = d._grams(data)
    assert len(grams) == len(data) - d.Q + 1 and (grams[:10] == grams[26:36]).all()
    assert len(np.unique(grams[:26])) == 26 and not len(d._grams(b"short"))
