"""The pipeline against brute force, stage by stage, and its contract."""

import sys
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import test_near_copies
import zlib

from textloom.llm import decision_lists, mixing, tokenizing
from textloom.llm.common import stored

sys.path.insert(0, str(Path(__file__).parents[2]))

import corpus_pipeline  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    tables = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, folder), f"test-{name}")
        tables[name] = docs
    return {name: t.collect() for name, t in tables.items()} | {"columns": {n: t.columns for n, t in tables.items()}}


def test_stages_and_columns(stages):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert stages["columns"][name] == COLUMNS


def test_quality_rules(spark, folder, stages):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rules = decision_lists.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    judged, out = decision_lists.judge(docs, rules)
    kept = {r.doc_id for r in judged.filter(f"{out}.kept").collect()}
    assert {r.doc_id for r in stages["quality_rules"]} == kept


def test_near_duplicates(stages):
    rows = [(r.doc_id, r.text) for r in stages["quality_rules"]]
    want = sorted(i for i, _ in test_near_copies.kept(rows))
    assert sorted(r.doc_id for r in stages["near_duplicates"]) == want and len(want) < len(rows)


def test_decontamination(spark, folder, stages):
    flat = lambda t: " ".join(t.lower().split())
    items = [flat(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    want = {r.doc_id for r in stages["near_duplicates"] if not any(i in flat(r.text) for i in items)}
    assert {r.doc_id for r in stages["decontamination"]} == want


def test_mixing(spark, stages):
    docs = spark.createDataFrame(stages["decontamination"], "doc_id long, text string, lang string, source string, n_chars long")
    times = {r.doc_id: int(r.taken / r["size"] + 0.5) for r in mixing.taken(docs).collect()}
    found = {}
    for r in stages["mixing"]:
        found[r.doc_id] = found.get(r.doc_id, 0) + 1
    assert found == {i: n for i, n in times.items() if n}


def test_packed_ids(stages):
    whole = tokenizing.load(public_tokenizers.path("word_bpe_49k.json"))
    want, start = [], 0
    for r in sorted(stages["mixing"], key=lambda r: (r.doc_id, r.text.encode())):
        ids = np.array([*whole.encode(r.text, add_special_tokens=False).ids, 1], "<u4")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, stages["packed_ids"])) == sorted(want)


def test_run_gives_the_last_stage(spark, folder, stages):
    found = corpus_pipeline.run(spark, folder)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, stages["packed_ids"]))


def test_empty_documents(spark, folder):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, folder), "empty")
        assert docs.count() == 0
