"""Token counts against the library on whole texts."""

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import queries, tokenizing

PATH = public_tokenizers.path("byte_bpe_50k.json")
WHOLE = tokenizing.load(PATH)

ODD = st.text(
    st.one_of(
        st.sampled_from(list(" \n\t\r\x0b\x0c\x1c\x85  　'sdlt<|>endoftx.,!0123aé́")),
        st.characters(exclude_categories=["Cs"]),
    ),
    max_size=60,
)
SPECIAL = st.lists(st.one_of(ODD, st.sampled_from(["<|endoftext|>", " ", "  ", "\n", "'s", "<|endof"])), max_size=8)


def library(text):
    return WHOLE.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(SPECIAL.map("".join))
def test_counts_by_word(text):
    assert tokenizing.counter(PATH, 1 << 20, 64).counts([text.encode()]) == [len(library(text))]


@settings(max_examples=300, deadline=None)
@given(SPECIAL.map("".join), st.integers(1, 12), st.integers(1, 6))
def test_spliced_ids(text, chunk, overlap):
    got = [i for part in tokenizing.spliced(WHOLE, text, chunk, overlap) for i in part.tolist()]
    assert got == library(text)


@pytest.mark.parametrize(
    "text",
    [
        "a" * 5000,
        " " * 5000,
        "<|endoftext|>" * 400,
        "word and 123 more, " * 600,
        "\n \n" * 900 + "x",
        "日本語のとても長い文" * 300,
    ],
)
def test_long_texts_without_boundaries(text):
    for chunk, overlap in ((64, 4), (500, 16)):
        got = [i for part in tokenizing.spliced(WHOLE, text, chunk, overlap) for i in part.tolist()]
        assert got == library(text)


def test_a_full_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(tokenizing, "CACHE_WORDS", 5)
    counting = tokenizing.TokenCounter(PATH, 1 << 20, 64)
    texts = ["one two three four five six seven", "eight nine ten", "one two eleven twelve thirteen"]
    for t in texts:
        assert counting.counts([t.encode()]) == [len(library(t))]
    assert len(counting.known) <= 8


def test_odd_rows(spark):
    texts = [None, "", " ", "a", "a  b\n\n c", "<|endoftext|> x", "é" * 40_000 + " end " * 9000, "w " * 600]
    rows = [(k, t, 5, "n") for k, t in enumerate(texts)] + [(None, "same", 5, "n"), (3, "a", 5, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, over_limit string")
    found = tokenizing.token_counts(docs, PATH)
    want = [
        (i, len((t or "").encode()), len(library(t or "")), len(library(t or "")) > 512) for i, t, *_ in rows
    ]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    assert tokenizing.token_counts(docs.limit(0), PATH).count() == 0


def test_query_against_the_library(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: r.n_tokens for r in queries.op8_token_counts(spark, folder).collect()}
    assert found == {r.doc_id: len(library(r.text)) for r in docs}


def test_whole_table_through_the_splice(spark, folder):
    table = spark.read.parquet(f"{folder}/documents.parquet")
    docs = table.select("doc_id", "text").collect()
    assert sum(len(r.text or "") > 160 for r in docs) > len(docs) * 0.9
    found = tokenizing.token_counts(table, PATH, chunk=160, overlap=8).collect()
    assert {r.doc_id: r.n_tokens for r in found} == {r.doc_id: len(library(r.text or "")) for r in docs}
