"""Near copies of the pipeline against exact similarity of all pairs, and planted copies."""

import random
import sys
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest

from textloom.llm import near_copies, shingles

sys.path.insert(0, str(Path(__file__).parents[2]))

from corpus_pipeline import near_duplicates  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(text):
    parts = (text or "").encode().lower().split()
    return {tuple(parts[i : i + 5]) for i in range(max(1, len(parts) - 4))} if parts else set()


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def kept(rows):
    """Places of the rows that stay: the smallest id of each component, ids before none."""
    sets, parent = [words_of(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                parent[find(i)] = find(j)
    best = {}
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0)):
        best.setdefault(find(i), i)
    return [rows[i] for i in best.values()]


def changed(draw, words, n):
    """A copy with ``n`` words changed, far enough apart that each costs five shingles."""
    words = list(words)
    for k in draw.sample(range(2, len(words) // 6 - 1), n):
        words[6 * k] = f"new{draw.randrange(10**9)}"
    return words


def planted(draw, groups):
    rows = []
    for g in range(groups):
        size = draw.choice([100, 200, 500])
        words = [f"w{draw.randrange(10**6)}" for _ in range(size)]
        n = draw.randint(1, int(size * 0.022))
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(changed(draw, words, n)))]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, "en", "s", 1) for r in rows], SCHEMA).repartition(8)


def test_planted_copies_are_found(spark):
    rows = planted(random.Random(1), 200)
    levels = [len(a & b) / len(a | b) for a, b in ((words_of(rows[k][1]), words_of(rows[k + 1][1])) for k in range(0, len(rows), 2))]
    assert min(levels) < 0.83 and max(levels) > 0.95 and min(levels) >= 0.8
    found = near_duplicates(spark, table(spark, rows), None)
    assert sorted(r.doc_id for r in found.collect()) == [2 * g for g in range(200)]


@pytest.mark.parametrize("seed", [1, 2])
def test_stage_against_all_pairs(spark, seed):
    """Also groups of copies of copies, of which many pairs are just not similar enough."""
    draw = random.Random(seed)
    rows = []
    for _ in range(12):
        first = [f"w{draw.randrange(10**6)}" for _ in range(200)]
        rows += [changed(draw, first, draw.randint(0, 8)) for _ in range(15)]
    rows = [(k, " ".join(w)) for k, w in enumerate(rows)]
    draw.shuffle(rows)
    found = near_duplicates(spark, table(spark, rows), None)
    assert sorted(r.doc_id for r in found.collect()) == sorted(i for i, _ in kept(rows))


def test_odd_rows(spark):
    one, two = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    rows = [(1, None), (2, ""), (3, " \t"), (4, "One two"), (None, "one  TWO"), (5, one), (None, two), (None, two + " x"), (6, "one two three")]
    found = near_duplicates(spark, table(spark, rows), None)
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = [r.doc_id for r in found.collect()]
    assert sorted(ids, key=repr) == [1, 4, 5, 6, None]
    assert near_copies.similarity(near_copies.hashes(b"a b c d e f"), near_copies.hashes(b"A b c d e")) == 0.5


def test_one_id_with_two_texts_and_rows_without_ids(spark):
    texts = [" ".join(f"{c}{k}" for k in range(60)) for c in "abcdef"]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[0]), (3, texts[1])] + [(None, t) for t in texts[1:]]
    found = near_duplicates(spark, table(spark, rows), None).collect()
    assert sorted((r.text, r.doc_id) for r in found) == [(t, 1 if k < 2 else None) for k, t in enumerate(texts)]


def copies_of_copies(draw, groups, size):
    rows = []
    for _ in range(groups):
        first = [f"w{draw.randrange(10**6)}" for _ in range(200)]
        rows += [first] + [changed(draw, first, draw.randint(0, 8)) for _ in range(size)]
    rows = [(k, " ".join(w)) for k, w in enumerate(rows)]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("limits", [(8, 1 << 30), (4096, 20_000)])
def test_groups_cut_into_parts_lose_nothing(spark, limits):
    rows = copies_of_copies(random.Random(3), 3, 40)
    found = near_copies.one_of_each(table(spark, rows), tile=limits[0], tile_bytes=limits[1])
    assert sorted(r.doc_id for r in found.collect()) == sorted(i for i, _ in kept(rows))


def test_rows_of_files_are_not_copied(spark, tmp_path):
    rows = [*copies_of_copies(random.Random(4), 4, 5), (None, None), (7, "")]
    table(spark, rows).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    read = shingles.with_row(docs, "row")
    assert read.select("row").distinct().count() == len(rows)
    assert read.inputFiles() == docs.inputFiles() or sorted(read.inputFiles()) == sorted(docs.inputFiles())
    found = near_copies.one_of_each(docs)
    assert sorted((r.doc_id for r in found.collect()), key=repr) == sorted((i for i, _ in kept(rows)), key=repr)


def test_counters_against_single_distances():
    draw = np.random.default_rng(1)
    base = draw.integers(0, 256, (1, 32), np.uint8)
    flips = draw.random((3000, 256)) < draw.random((3000, 1)) * 0.5
    sketches = base ^ np.packbits(flips, axis=1, bitorder="little")
    planes = near_copies.Planes(sketches)
    gone = draw.choice(3000, 700, replace=False)
    planes.drop(gone)
    for one in range(0, 3000, 100):
        far = np.bitwise_count(sketches ^ sketches[one]).sum(axis=1)
        for radius in (0, 39, 64, 80, 127):
            want = set(np.flatnonzero(far <= radius)) - set(gone)
            assert set(planes.within(one, radius)) == want


def test_sketches_of_similar_texts_lie_within_the_radius():
    """At the least similarity sketches stay well inside the radius, at none they are far outside."""
    draw, far, apart = random.Random(2), [], []
    for _ in range(300):
        first = [f"w{draw.randrange(10**6)}" for _ in range(200)]
        a, b, c = (near_copies.sketch(near_copies.hashes(" ".join(w).encode())) for w in (first, changed(draw, first, 4), first[::-1]))
        a, b, c = (np.frombuffer(x, np.uint8) for x in (a, b, c))
        far.append(np.bitwise_count(a ^ b).sum())
        apart.append(np.bitwise_count(a ^ c).sum())
    assert max(far) < 65 and min(apart) > 90


def test_exact_links_against_all_pairs():
    draw = np.random.default_rng(3)
    for least in (Fraction(4, 5), Fraction(17, 20), Fraction(1, 2)):
        base = draw.integers(0, 1 << 60, 60).astype(np.uint64)
        sets = [np.unique(np.r_[draw.choice(base, draw.integers(30, 60), replace=False), draw.integers(0, 1 << 60, draw.integers(0, 6)).astype(np.uint64)]) for _ in range(80)]
        core = np.zeros(80, bool)
        core[[3, 9, 11]] = True
        for mask in (None, core):
            parent = list(range(80))

            def find(x):
                while parent[x] != x:
                    x = parent[x]
                return x

            def joined(links):
                for k in range(80):
                    parent[k] = k
                if mask is not None:
                    parent[9] = parent[11] = 3
                for x, y in links:
                    parent[find(x)] = find(y)
                return [find(x) for x in range(80)]

            found = shingles.exact_links(sets, least, mask)
            assert len(found) < 80 and all(shingles.similarity(sets[x], sets[y]) >= least for x, y in found)
            got = joined(found)
            want = joined([(x, y) for x in range(80) for y in range(x) if shingles.similarity(sets[x], sets[y]) >= float(least)])
            assert all((got[x] == got[y]) == (want[x] == want[y]) for x in range(80) for y in range(x))
