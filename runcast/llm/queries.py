"""One query per operator over the whole table it is meant for, and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from runcast.llm import (attention_quality, chat_format, context_tree, jump_shards, page_difference, prefix_trie, quality_rules,
                         raking, secret_ownership, simhash_groups, suffix_decontamination, url_verdicts, whitening)
from runcast.llm.common import read_table

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups.near_duplicate_groups(read_table(spark, sf_dir, "documents"))


def op2_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.scored_documents(read_table(spark, sf_dir, "documents"))


def op3_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_quality.scored_documents(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jump_shards.sharded_documents(read_table(spark, sf_dir, "documents"))


def op5_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raking.mixed_documents(read_table(spark, sf_dir, "documents"))


def op6_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_ownership.secret_documents(read_table(spark, sf_dir, "documents"))


def op7_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts.judged_pages(read_table(spark, sf_dir, "pages"))


def op8_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_decontamination.find_matches(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op9_page_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_difference.main_texts(read_table(spark, sf_dir, "pages"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged_documents(read_table(spark, sf_dir, "documents"))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.formatted_conversations(read_table(spark, sf_dir, "conversations"))


def op12_whitened_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_components(read_table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(read_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Query] = {function.__name__: function for function in (
    op1_simhash_groups, op2_context_tree, op3_attention_quality, op4_jump_shards, op5_raked_mixture, op6_secret_ownership,
    op7_url_verdicts, op8_suffix_decontamination, op9_page_difference, op10_quality_rules, op11_chat_format,
    op12_whitened_components, op13_prefix_trie)}

ORACLE_SQL: dict[str, str] = {
    "op4_jump_shards": jump_shards.oracle(),
    "op5_raked_mixture": raking.oracle(),
    "op6_secret_ownership": secret_ownership.ORACLE,
    "op7_url_verdicts": url_verdicts.ORACLE,
    "op8_suffix_decontamination": suffix_decontamination.ORACLE,
    "op10_quality_rules": quality_rules.oracle(),
    "op11_chat_format": chat_format.ORACLE,
    "op13_prefix_trie": prefix_trie.ORACLE,
}
