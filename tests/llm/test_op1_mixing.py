"""Mixing: targets, the schedule and words taken, against plain Python."""

import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import mixing, queries


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """sizes: words by source."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode())
    order += [None] if None in sizes else []
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    fixed, free = {}, set(order)
    while free:
        left = share * sum(sizes.values()) - sum(fixed.values())
        level = left / sum(weight[s] for s in free)
        above = {s for s in free if level * weight[s] > most * sizes[s]}
        if not above:
            return fixed | {s: level * weight[s] for s in free}
        fixed |= {s: float(most * sizes[s]) for s in above}
        free -= above
    return fixed


def check(rows, found):
    """rows: (doc_id, source, text) with distinct ids; found: by doc_id."""
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, _, t in rows}
    by_source, taken = defaultdict(int), defaultdict(int)
    for i, s, _ in rows:
        by_source[s] += sizes[i]
    targets = plain_targets(dict(by_source))
    assert set(found) == set(sizes)
    for i, s, _ in rows:
        r = found[i]
        assert (r["size"], r["source_size"]) == (sizes[i], by_source[s])
        assert r["target"] == pytest.approx(targets[s], rel=1e-9, abs=1e-9)
        assert 0 <= r["taken"] <= 2 * sizes[i]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - targets[s]) <= 0.5 + 1e-6 for s in by_source)


def test_schedule_ranks_and_reversal(spark):
    bits = 6
    rows = spark.range(1 << bits).select(
        F.col("id"),
        mixing.reversed_bits(F.col("id"), bits).alias("position"),
        mixing.rank_in(F.col("id"), F.lit(11), F.lit(47), bits).alias("rank"),
    )
    found = {r.id: (r.position, r.rank) for r in rows.collect()}
    for i, (position, _) in found.items():
        assert position == int(f"{i:0{bits}b}"[::-1], 2)
    inside = sorted(range(11, 47), key=lambda i: found[i][0])
    assert [found[i][1] for i in inside] == list(range(36))


@pytest.mark.parametrize("blocks", [[5, 3, 8], [1], [0, 7, 0], [1000, 1, 20_000]])
def test_schedule_has_each_block_once_and_spreads_sources(spark, blocks):
    sources = spark.createDataFrame(list(enumerate(blocks)), "s int, blocks long")
    rows = mixing.schedule(sources).collect()
    assert sorted((r.s, r.block) for r in rows) == sorted(
        (s, b) for s, n in enumerate(blocks) for b in range(n)
    )
    order = sorted(rows, key=lambda r: r.position)
    assert len({r.position for r in rows}) == len(rows)
    share = np.array(blocks) / sum(blocks)
    seen = np.zeros(len(blocks))
    for k, r in enumerate(order, 1):
        assert r.block == seen[r.s]  # a source's blocks come in order
        seen[r.s] += 1
        assert np.abs(seen - k * share).max() <= 2 * len(order).bit_length()


def test_words_of_the_mix(spark):
    rows = [(k, f"s{k % 4}", " ".join(f"d{k}w{j}" for j in range(k % 37))) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    sizes, sources, found = mixing.mix(docs, block_words=16)
    by_slot = defaultdict(list)
    for r in found.collect():
        assert 0 <= r.from_word < r.to_word <= len(rows[r.doc_id][2].split())
        by_slot[r.s, r.block, r.position].append(r.to_word - r.from_word)
    take = {r.s: r["take"] for r in sources.collect()}
    for (s, block, _), parts in by_slot.items():
        assert sum(parts) == min(16, take[s] - 16 * block)  # every block is full, but the last


def test_odd_rows(spark):
    rows = [(1, None, "a b c d"), (2, None, None), (3, "", "x y"), (4, "b", "  "), (5, "é", "one two\x0bthree " * 50), (6, "B", "w " * 4000), (7, "zero", ""), (8, "é", "q\x1cr")]
    docs = spark.createDataFrame(
        [(i, s, t, 1, 2, "n") for i, s, t in rows],
        "doc_id long, source string, text string, size int, s int, target string",
    )
    found = {r.doc_id: r.asDict() for r in mixing.taken(docs, block_words=8).collect()}
    check(rows, found)
    assert mixing.taken(docs.limit(0)).count() == 0
    assert mixing.taken(docs.filter("doc_id in (2, 4, 7)")).agg(F.sum("taken")).first()[0] == 0


def test_repeated_rows_count_each_for_itself(spark):
    docs = spark.createDataFrame([(1, "a", "u v w")] * 6 + [(None, "a", "u v w")] * 2, "doc_id long, source string, text string")
    rows = mixing.taken(docs, block_words=2).collect()
    assert len(rows) == 8 and all(r["size"] == 3 and r.taken <= 6 for r in rows)
    assert sum(r.taken for r in rows) == 36  # one source: all it may give is 150 % of 24


def test_small_buckets_place_the_same_words(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 3)
    monkeypatch.setattr(mixing, "STRETCH", 4)
    rows = [(k, "ab"[k % 3 == 0], "w " * (k % 11)) for k in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    check(rows, {r.doc_id: r.asDict() for r in mixing.taken(docs, block_words=4).collect()})


def test_rows_that_repeat_share_no_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 64)
    same = [(None, "a", "u v w")] * 6000 + [(5, "a", f"five {k}") for k in range(6000)]
    rows = same + [(k, "a", "x y") for k in range(10, 6010)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(8)
    sizes, sources, _ = mixing.mix(docs, block_words=16)
    groups = mixing.dealt(sizes, sources).groupBy("bucket", "part").count()
    assert groups.agg(F.max("count")).first()[0] <= 8 * 64
    placed = mixing.streams(sizes, sources).select("at", "size").orderBy("at").collect()
    assert len(placed) == len(rows)
    assert [r["at"] for r in placed] == np.cumsum([0] + [r["size"] for r in placed[:-1]]).tolist()


def test_query_and_reruns(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source", "text").collect()]
    first = {r.doc_id: r.asDict() for r in queries.op1_mixing(spark, folder).collect()}
    check(rows, first)
    assert first == {r.doc_id: r.asDict() for r in queries.op1_mixing(spark, folder).collect()}


def test_mixed_documents_come_as_often_as_they_are_read(spark):
    rows = [(k, "ab"[k % 2], "w " * (5 + k % 7), k) for k in range(60)] + [(None, "a", "n o p", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, _drawn_id int")
    taken = {r.doc_id: (r.taken, r["size"]) for r in mixing.taken(docs, block_words=4).collect()}
    found = mixing.mixed_documents(docs, block_words=4)
    assert found.columns == docs.columns
    times = defaultdict(int)
    for r in found.collect():
        times[r.doc_id] += 1
    assert {i: int(t / n + 0.5) for i, (t, n) in taken.items() if int(t / n + 0.5)} == dict(times)
