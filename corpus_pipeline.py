"""From documents to packed token ids, a stage at a time.

Each stage works on all that the one before it kept: it is written as Parquet to
the shared folder and read again. All but the last return the columns of the
documents. The result has a row for each document of the mix, as often as the
mix reads it, with its place in the packed ids.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from textloom.llm import decision_lists, decontamination, mixing, near_copies, packing
from textloom.llm.common import stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned list reject."""
    rules = decision_lists.fit(docs, table(spark, sf_dir, "labels"))
    judged, out = decision_lists.judge(docs, rules)
    return judged.filter(f"{out}.kept").drop(out)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id."""
    return near_copies.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources reads them."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place, tokens and checksum of each document in the packed ids."""
    found = packing.packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("packed_ids", packed),
]

#: Hashes, learned rules, alignments and tokens are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
