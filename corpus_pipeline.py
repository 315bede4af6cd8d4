"""The corpus pipeline: quality rules, quality classifier, near-dedup and packing, in this order.

Each stage reads what its predecessor kept and wrote. The first three return documents with
their columns as they came; the last returns the pieces of packed sequences. Nothing is cut off,
sampled or capped between the stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from omegalake.llm import packing, quality_net, quality_rules, simhash
from omegalake.llm.common import staged, table


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line-first rules: documents that they reject go."""
    return quality_rules.kept_documents(docs)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level network, fitted on the labelled rows of the whole table: documents that it rejects go."""
    net = quality_net.fit_on_labels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_net.kept_documents(docs, net)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash components: one document of each group stays."""
    return simhash.distinct_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing into sequences of 1024 tokens: a row for each piece."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL has neither the tokenizer nor the network.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
