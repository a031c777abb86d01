"""MinHash near-duplicates against exact similarity of all pairs, and planted copies."""

import random

import numpy as np
import pytest

from textloom.llm import minhash, shingles
from textloom.llm.queries import op12_minhash


def sets_of(text):
    parts = (text or "").encode().lower().split()
    return {tuple(parts[i : i + 3]) for i in range(max(1, len(parts) - 2))} if parts else set()


def expected(rows):
    """(doc_id, n_shingles, component_id, kept) of each row, by all pairs that share a shingle."""
    sets, parent = [sets_of(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders = {}
    for i, own in enumerate(sets):
        both = {}
        for s in own:
            for j in holders.setdefault(s, []):
                both[j] = both.get(j, 0) + 1
            holders[s].append(i)
        for j, n in both.items():
            if 100 * n >= 85 * (len(own) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    least = {}
    for i, (number, _) in enumerate(rows):
        if number is not None:
            least[find(i)] = min(number, least.get(find(i), number))
    out = []
    for i, (number, _) in enumerate(rows):
        component = least.get(find(i)) if sets[i] else number
        out.append((number, len(sets[i]), component, number == component))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


def changed(draw, words, n):
    words = list(words)
    for k in draw.sample(range(1, len(words) // 4 - 1), n):
        words[4 * k] = f"new{draw.randrange(10**9)}"
    return words


def copies(draw, groups, size, most):
    rows = []
    for _ in range(groups):
        first = [f"w{draw.randrange(10**6)}" for _ in range(draw.choice([60, 150, 400]))]
        rows += [" ".join(changed(draw, first, draw.randint(0, max(1, len(first) // most)))) for _ in range(size)]
    draw.shuffle(rows)
    return list(enumerate(rows))


def test_query(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert got(op12_minhash(spark, folder)) == expected(rows)


@pytest.mark.parametrize("limits", [(4096, 1 << 25), (6, 1 << 30), (4096, 9000)])
def test_copies_of_copies(spark, limits):
    """Also groups of which many pairs are just not similar enough, and groups cut into parts."""
    rows = copies(random.Random(limits[0]), 8, 30, 40)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    want = expected(rows)
    assert got(minhash.linked(df, tile=limits[0], tile_bytes=limits[1])) == want
    assert 8 <= sum(k for *_, k in want) < 240


def test_recall_at_the_least_similarity(spark):
    """Pairs of a similarity of 0.85 to 0.87, each a component of its own."""
    draw, rows = random.Random(5), []
    for g in range(400):
        first = [f"w{draw.randrange(10**8)}" for _ in range(202)]
        rows += [(2 * g, " ".join(first)), (2 * g + 1, " ".join(changed(draw, first, 5)))]
    levels = [len(sets_of(rows[k][1]) & sets_of(rows[k + 1][1])) / len(sets_of(rows[k][1]) | sets_of(rows[k + 1][1])) for k in range(0, 800, 2)]
    assert min(levels) >= 0.85 and max(levels) < 0.88
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert minhash.linked(df).filter("kept").count() <= 401


def test_odd_rows(spark):
    one, two = (" ".join(f"{c}{k}" for k in range(40)) for c in "ab")
    rows = [(1, None), (2, ""), (3, " \t"), (4, "One two"), (None, "one  TWO"), (5, one), (5, one), (None, two), (None, two + " x"), (6, "word"), (None, None), (0, "WORD")]
    df = spark.createDataFrame([(*r, 1, 2, "s") for r in rows], "doc_id long, text string, row int, node int, sketch string")
    assert got(minhash.linked(df)) == expected(rows)
    assert got(minhash.linked(df.filter("false"))) == []


def test_a_group_of_copies_is_dealt_out(spark):
    """The members of a dense group meet its centre once, not each other."""
    draw = random.Random(6)
    first = [f"w{draw.randrange(10**6)}" for _ in range(300)]
    rows = [(k, " ".join(changed(draw, first, 1))) for k in range(600)] + [(600 + k, f"other text number {k} of its own") for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    found = minhash.linked(df, tile=16)
    assert got(found) == expected(rows)


def test_tensored_keys():
    draw = np.random.default_rng(1)
    own = draw.integers(0, 1 << 63, 100).astype(np.uint64)
    keys, sketch = minhash.keys_and_sketch(np.sort(own))
    assert len(keys) == 2 * minhash.HALVES and len(sketch) == 2 * len(keys) * minhash.ROWS
    assert minhash.keys_and_sketch(np.sort(draw.permutation(own))) == (keys, sketch)
    s = 0.85
    assert (1 - (1 - s**minhash.ROWS) ** minhash.HALVES) ** 2 > 0.9998
    assert shingles.hashes(b"a b", 3).size == 1 and shingles.hashes(b"", 3).size == 0
