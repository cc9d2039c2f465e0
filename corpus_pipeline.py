"""A training corpus from raw documents: good texts, one of each near-duplicate group, clean of benchmarks, mixed, sharded.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame. Rows go from stage to
stage as Parquet in the shared folder. Every stage but the last returns the columns of ``documents``.

In every stage a row is decided by its own text, source and id, so rows that share an id, or have none, do not decide for each other.
Null texts count as empty. Columns beyond those of ``documents`` go through, whatever their names, but names that begin
with ``__il_`` are refused before the first stage. Very long texts are read whole. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tieout.llm import decontaminate, mixing, neardup, quality, sharding
from tieout.llm.storage import written
from tieout.session import ship_package


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier of operator 2 does not reject.

    Null and empty texts score as any text without words; equal texts go or stay together; without labels all stay.
    """
    ship_package(spark)
    return quality.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate component (operator 7).

    Texts without words are linked with nothing and stay, repeated or not. A null id gives way to a set's smallest id; rows equal in id
    and set leave one.
    """
    ship_package(spark)
    return neardup.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item within reach (operator 6).

    Null and empty texts and items match nothing; repeated rows go or stay together.
    """
    ship_package(spark)
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them (operator 4).

    Texts without words have nothing to take and go. A null source is one of its own, last in order. Ties are broken by a seeded hash.
    """
    return mixing.mixed_documents(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and slot (operator 8).

    Null and empty texts, null sources and repeated rows are placed as any other row.
    """
    return sharding.interleave(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]
#: Learnt scores and the seeded md5 orders of hundreds of ranges have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sharding.refuse_reserved(docs.columns)  # before the first stage, not in the last
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
