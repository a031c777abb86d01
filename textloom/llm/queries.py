"""Queries of this package: each applies one operator to its whole table."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import (
    decision_lists,
    decontamination,
    minhash,
    mixing,
    packing,
    personal_data,
    simhash,
    tokenizing,
    url_filter,
    variants,
    warc,
    weak_labels,
    whitening,
)
from textloom.llm.common import table

#: Rules that the url query judges by.
URL_RULES = [
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.taken(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = table(spark, sf_dir, "pages").select("page_id", "url")
    judged, out = url_filter.judge(urls, URL_RULES)
    return judged.select("page_id", f"{out}.*")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.linked(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archived(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged, out = weak_labels.judge(docs, weak_labels.fit(docs))
    return judged.select("doc_id", f"{out}.*")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminations(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.digests(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return tokenizing.token_counts(table(spark, sf_dir, "documents"), path)


def op9_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    found = packing.packed_documents(table(spark, sf_dir, "documents"), path)
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = decision_lists.fit(docs, table(spark, sf_dir, "labels"))
    judged, out = decision_lists.judge(docs, rules)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select(
        "doc_id",
        *(F.col(f"{out}.stats.{c}").alias(c) for c in counts),
        F.col(f"{out}.base_failed").alias("base_failed"),
        F.col(f"{out}.kept").alias("kept"),
        F.col(f"{out}.rule").alias("rule"),
    )


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.linked(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, out = whitening.whitened(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.select("vec_id", f"{out}.*")


QUERIES = {
    "op1_mixing": (op1_mixing, None),
    "op2_url_filter": (op2_url_filter, None),
    "op3_simhash": (op3_simhash, None),
    "op4_warc": (op4_warc, None),
    "op5_weak_labels": (op5_weak_labels, None),
    "op6_decontamination": (op6_decontamination, None),
    "op7_personal_data": (op7_personal_data, None),
    "op8_token_counts": (op8_token_counts, None),
    "op9_packed_ids": (op9_packed_ids, None),
    "op10_decision_list": (op10_decision_list, None),
    "op11_spelling_variants": (op11_spelling_variants, None),
    "op12_minhash": (op12_minhash, None),
    "op13_whitening": (op13_whitening, None),
}
