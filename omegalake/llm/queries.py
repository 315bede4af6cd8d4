"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, conversation_repair, hash_forest, html_extract, license_scan, packing, prefix_trie, quality_net, quality_rules, quote_linking, simhash, token_shards, url_filter
from .common import fresh_path, table


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-shards")
    token_shards.write_shards(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_shards.shard_rows(token_shards.read_shards(spark, path)).withColumnRenamed("key", "doc_id")


def op2_quality_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_net.score(docs, quality_net.fit_on_labels(docs, table(spark, sf_dir, "labels")))


def op3_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return hash_forest.nearest(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex().alias("fingerprint"), "component_id")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op6_line_first_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents")).drop("clean_text")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"), html_extract.train())


def op10_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quote_linking.as_conversations(quote_linking.link_quotes(table(spark, sf_dir, "conversations"), nested=True))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return conversation_repair.reports(conversation_repair.damaged(conversations), conversations)


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_shards": op1_token_shards,
    "op2_quality_net": op2_quality_net,
    "op3_hash_forest": op3_hash_forest,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_license_scan": op5_license_scan,
    "op6_line_first_rules": op6_line_first_rules,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_html_extract": op9_html_extract,
    "op10_quote_linking": op10_quote_linking,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_url_filter": op12_url_filter,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {"op5_license_scan": license_scan.ORACLE_SQL, "op6_line_first_rules": quality_rules.ORACLE_SQL, "op12_url_filter": url_filter.ORACLE_SQL}
