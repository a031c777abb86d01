"""SimHash against plain Python: fingerprints, links, components and odd rows."""

import random
import re

import numpy as np
import pytest
import xxhash

from textloom.llm import queries, simhash


def plain_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints, radius=3):
    """Smallest id reachable from each row; rows without an id are nobody's smallest."""
    n, parent = len(prints), list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    smallest = {}
    for i in range(n):
        if ids[i] is not None:
            r = find(i)
            smallest[r] = min(smallest.get(r, ids[i]), ids[i])
    return [smallest.get(find(i)) for i in range(n)]


def expected(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    found = plain_components([i for i, _ in rows], prints)
    return sorted(
        ((i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, found)), key=repr
    )


def clustered(seed, centres, around, most):
    draw = np.random.default_rng(seed)
    out = []
    for c in draw.integers(0, 2**63, centres, dtype=np.uint64):
        for _ in range(around):
            x = int(c)
            for b in draw.integers(0, 64, draw.integers(0, most)):
                x ^= 1 << int(b)
            out.append(x)
    return np.unique(np.array(out, np.uint64))


@pytest.mark.parametrize("radius", [0, 1, 3, 5, 7])
def test_bit_planes_find_all_within_the_radius(radius):
    prints = clustered(radius, 8, 200, 9)
    planes = simhash.Planes(prints)
    for k in range(0, len(prints), 31):
        near = np.flatnonzero(np.bitwise_count(prints ^ prints[k]) <= radius)
        assert planes.within(int(prints[k]), radius).tolist() == near.tolist()


def test_dropped_fingerprints_are_not_found():
    prints = np.arange(1, 200, dtype=np.uint64)
    planes = simhash.Planes(prints)
    planes.drop(np.array([0, 5, 198]))
    assert not {0, 5, 198} & set(planes.within(1, 7).tolist())


def test_forest_connects_what_links_connect():
    prints = clustered(3, 6, 80, 6)
    links = simhash.forest(prints)
    assert len(links) < len(prints)
    assert all((int(prints[a]) ^ int(prints[b])).bit_count() <= 3 for a, b in links)
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    ids = list(range(len(prints)))
    assert [find(i) for i in ids] == plain_components(ids, [int(p) for p in prints])


def test_any_three_bits_leave_two_blocks_alike():
    masks = simhash.block_masks(3)
    draw = random.Random(1)
    for _ in range(500):
        x = 0
        for b in draw.sample(range(64), 3):
            x |= 1 << b
        assert any(not x & m for m in masks)


@pytest.mark.parametrize("tile", [4, 16, 4096])
def test_links_do_not_depend_on_the_size_of_tiles(spark, tile):
    prints = clustered(5, 5, 60, 5)
    table = spark.createDataFrame([(int(x.view(np.int64)),) for x in prints], "fp long")
    links = [tuple(r) for r in simhash.near_links(table, tile=tile).collect()]
    place = {int(x.view(np.int64)): k for k, x in enumerate(prints)}
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(place[a]), find(place[b])
        parent[max(a, b)] = min(a, b)
    ids = list(range(len(prints)))
    assert [find(i) for i in ids] == plain_components(ids, [int(p) for p in prints])


def test_components_of_chains_stars_and_loops(spark):
    chain = [(k, k + 1) for k in range(100, 140)]
    star = [(200, k) for k in range(201, 300)]
    loop = [(5, -3), (-3, 7), (7, 5), (5, 5)]
    rows = spark.createDataFrame(chain + star + loop, "a long, b long")
    found = dict(map(tuple, simhash.components(rows).collect()))
    assert all(found[k] == 100 for k in range(101, 141))
    assert all(found[k] == 200 for k in range(201, 300))
    assert found[5] == found[7] == -3
    assert simhash.components(rows.limit(0)).count() == 0


def test_odd_rows(spark):
    words = [f"w{k}" for k in range(300)]
    near = " ".join(words)
    rows = [
        (4, near),
        (9, near.upper()),
        (None, near.replace("w150", "changed")),
        (2, None),
        (7, ""),
        (7, ""),
        (8, " \t\n"),
        (1, "one"),
        (3, "One two"),
        (6, "é   ü\x1cß"),
        (None, "alone here by itself now"),
        (11, "x" * 100_000),
        (12, "la " * 50_000),
    ]
    docs = spark.createDataFrame(
        [(i, t, "a", 1, 2) for i, t in rows],
        "doc_id long, text string, fp string, component_id int, root int",
    )
    found = simhash.linked(docs)
    assert sorted(map(tuple, found.collect()), key=repr) == expected(rows)
    assert simhash.linked(docs.limit(0)).count() == 0


def test_one_of_each_keeps_a_row_for_each_component(spark):
    text = " ".join(f"word{k}" for k in range(200))
    rows = [(5, text), (3, text), (3, text), (8, "something else here"), (9, None), (10, "")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 8, 9]


def test_query_against_brute_force(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    found = queries.op3_simhash(spark, folder)
    assert sorted(map(tuple, found.collect()), key=repr) == expected(rows)
