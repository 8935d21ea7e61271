"""A training corpus from raw documents: five stages, each a written table that the next one reads.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns the documents it
keeps with their own columns, and the last one the documents with their shards. ``run`` applies them.
Model fits, components and ring places have no SQL form, so ``ORACLE_SQL`` is None; the tests hold the
result against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillwork.llm import decontaminate, language, mixing, near_copies, sharding
from tillwork.llm.common import table
from tillwork.staging import stage

# Tokens left after the mix, and no text twice.
MIX = mixing.Mix(mixing.PRODUCTION.weights, budget_share=0.8, max_epochs=1, seed=mixing.PRODUCTION.seed)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.keep_mixed(docs, MIX)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(docs)


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("decontaminate", drop_benchmark_leaks),
    ("mix", mix_sources),
    ("shard", shard),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, work in STAGES[:-1]:
        docs = stage(work(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
