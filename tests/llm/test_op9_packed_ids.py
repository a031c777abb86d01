"""Packed ids: round trips, random access, and the library on whole texts."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import packing, queries, tokenizing

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = tokenizing.load(PATH)

ODD = st.text(
    st.one_of(
        st.sampled_from(list(" \n\t\x1c\x85  'SDLT<|>endoftxIİıΣς́̇ÀÉ.,0")),
        st.characters(exclude_categories=["Cs"]),
    ),
    max_size=60,
)
TEXTS = st.lists(
    st.one_of(ODD, st.sampled_from(["<|endoftext|>", "<|EndOfText|>", "<|startoftext|>", " ", "'LL"])), max_size=8
).map("".join)


def library(text):
    return WHOLE.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 11, 16, 17, 24, 31, 32])
def test_packing_round_trip(bits):
    draw = np.random.default_rng(bits)
    for n in (0, 1, 7, 8, 9, 1000):
        ids = draw.integers(0, 1 << bits, n, dtype=np.uint64).astype("<u4")
        packed = packing.pack(ids, bits)
        assert len(packed) == (n * bits + 7) // 8
        assert packing.unpack(packed, n, bits).tolist() == ids.tolist()


def test_width():
    assert [packing.width(n) for n in (1, 2, 3, 256, 257, 49_408, 65_536, 65_537)] == [1, 1, 2, 8, 9, 16, 16, 17]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2000), max_size=40), max_size=12), st.integers(1, 9))
def test_shard_round_trip_and_random_access(docs, block):
    writer = packing.Writer(3, 11, block)
    rows = [writer.begin()]
    for k, ids in enumerate(docs):
        rows += writer.add([None if k == 1 else k], [np.array(ids, "<u4").tobytes()])
    rows += writer.end()
    shard = packing.Shard(b"".join(r + b"\n" for r in rows))
    assert [d.tolist() for d in shard.documents()] == docs
    assert shard.doc_ids[~shard.nulls].tolist() == [k for k in range(len(docs)) if k != 1]
    flat = [i for ids in docs for i in ids]
    for start in range(0, len(flat), 7):
        stop = min(len(flat), start + 11)
        assert shard.ids(start, stop).tolist() == flat[start:stop]


def test_a_cut_shard_is_refused():
    writer = packing.Writer(0, 16, 8)
    rows = [writer.begin(), *writer.add([1], [np.arange(20, dtype="<u4").tobytes()]), *writer.end()]
    content = b"".join(r + b"\n" for r in rows)
    with pytest.raises(ValueError):
        packing.Shard(content[:-9])


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_ids_by_word(text):
    got = np.frombuffer(tokenizing.encoder(PATH).encode([text.encode()])[0], "<u4")
    assert got.tolist() == library(text)


def expected(rows):
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        ids = np.array([*library(t or ""), 1], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [1, 2000, 1 << 20])
def test_odd_rows(spark, size):
    rows = [(9, None), (4, ""), (7, "Seven words, or so!"), (None, "no id"), (2, "a" * 3000), (2, "b"), (4, ""), (-5, "x y " * 900)]
    docs = spark.createDataFrame(
        [(i, t, 1, "s") for i, t in rows], "doc_id long, text string, start int, shard string"
    )
    found = packing.packed_documents(docs, PATH, shard_bytes=size, block_ids=16).drop("shard")
    assert sorted(map(tuple, found.collect()), key=repr) == expected(rows)


def test_rows_of_one_id_go_to_many_shards(spark):
    rows = [(7, "same text")] * 2000 + [(8, f"{k} of many") for k in range(2000)]
    rows += [(None, f"no id {k}") for k in range(1000)] + [(k, "x y z") for k in range(10, 1010)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    size = sum(len(t) for _, t in rows)
    found = packing.packed_documents(docs, PATH, shard_bytes=size // 16, block_ids=64)
    shards = [r["count"] for r in found.groupBy("shard").count().collect()]
    assert sum(shards) == len(rows) and max(shards) <= 3 * len(rows) / 16
    placed = found.orderBy("start").collect()
    assert [r.start for r in placed] == np.cumsum([0] + [r.n_tokens for r in placed[:-1]]).tolist()
    assert [r.doc_id for r in placed] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    same = {(r.n_tokens, r.ids_crc32) for r in placed if r.doc_id == 7}
    ids = np.array([*library("same text"), 1], "<u4")
    assert same == {(len(ids), zlib.crc32(ids.tobytes()))}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.packed_documents(docs, PATH).count() == 0


def test_query_against_the_library(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    found = queries.op9_packed_ids(spark, folder)
    assert sorted(map(tuple, found.collect()), key=repr) == expected([tuple(r) for r in docs])
