"""The corpus pipeline: five stages, each on all that its predecessor kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame. ``run`` writes each stage as Parquet in the shared
checkpoint folder and hands the reread table to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, mixing, rules, sharding, simhash
from tessera.llm.common import materialize, read, ship_package

#: Budget of the mixing stage in parts of the tokens that reach it; each document is taken once at most.
MIX_RATIO = 0.9


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, that of the least id."""
    return simhash.keep_one(docs, shingle=3, max_bits=2)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that benchmark windows cover."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents taken by the hierarchical budget, each once at most."""
    return mixing.mixed(docs, budget_ratio=MIX_RATIO, max_epochs=1)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's shard and slot."""
    return sharding.shard(docs, 40)


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("decontamination", decontamination),
          ("mixture", mixture), ("shards", shards)]

#: Suffix order, connected components and heap scheduling have no DuckDB form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of ``sf_dir``."""
    ship_package(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), spark, name.replace(" ", "-"))
    return docs
