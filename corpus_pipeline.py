"""A training corpus from raw documents: classify, deduplicate, decontaminate, mix and shard.

Every stage is ``(spark, docs, sf_dir) -> DataFrame`` over all rows its predecessor kept; all but the last
return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runcast.llm import attention_quality, jump_shards, raking, simhash_groups, suffix_decontamination
from runcast.llm.common import read_table, word_count
from runcast.session import materialize

MIX_BUDGET = 0.7
N_SHARDS = 40


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return attention_quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: fingerprints of three-word shingles, linked at 3 bits or fewer."""
    return simhash_groups.keep_one_per_group(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return suffix_decontamination.remove_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens are spread over sources, languages and topics as the targets say."""
    text = F.col("text")
    told = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "source", "lang",
                       raking.topic_of(text).alias("topic"), word_count(text).alias("n_tokens"))
    return raking.mix(told, raking.TARGETS, MIX_BUDGET).where("kept").select("_row.*")


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard of every document, in a column ``shard``."""
    return jump_shards.with_shards(docs, N_SHARDS)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("sharding", sharding),
]

# the classifier is learned, so no SQL gives these rows; tests/llm compares the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
