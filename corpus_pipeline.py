"""A corpus pipeline of five stages: quality rules, near-dedup, decontamination, mixing to target weights, sharding.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns the columns of documents;
the last adds ``shard``. Between stages the rows are written as Parquet in the shared folder and read again; a stage's table
is deleted when the next one is written.

Cases: null and empty texts fail the quality rules, so only a stage that is run by itself meets them (near-dedup takes
texts without words as one class and each null text as its own; decontamination keeps both; mixing drops them, as no
words are taken; sharding places them); an empty table gives an empty one at every stage, an empty benchmark contaminates
nothing; repeated rows are one class of near-dedup, so one of them stays; ties go to the least id, then the least hash of
the text; rows without an id are documents like others; very long texts are read whole; extra columns pass through all stages, whatever their names,
but for one named ``shard``, which the last stage replaces; ids keep their type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideline.llm import decontam, dedup, mixing, quality_rules, sharding
from tideline.llm.common import discard, materialize
from tideline.session import table

SHARDS = 16


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without lines above their host's limit."""
    return quality_rules.clean_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return dedup.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard; bytes are balanced, copies stay together."""
    return sharding.shard_documents(docs, SHARDS)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix_sources", mix_sources), ("shard", shard)]

#: Near-dedup and differencing have no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if last is not None:
            discard(last)
        last = docs
    return docs
