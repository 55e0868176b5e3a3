"""Corpus pipeline: each stage calls one corpus operator on what the stage before it kept.

Languages nobody can name go, one document of each group of near-duplicates stays, documents with a
benchmark passage go, sources are replicated to their target weights, and rows are dealt to 40 shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetpulse.llm import decontam, langid, mixing, sharding, simhash
from fleetpulse.llm.common import read_table
from fleetpulse.plans.tables import materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows without letters and rows like no language of the training rows."""
    return langid.keep_known(docs, langid.collect_prototypes(langid.fit_prototypes(langid.training_rows(docs))))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of fingerprints (three-word shingles) that differ in two bits at most."""
    return simhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that hold a passage of the benchmark."""
    return decontam.drop_leaking(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its source's rate has it, in shuffled order."""
    return mixing.replicate(docs).select(*[f"`{c}`" for c in docs.columns])


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the shard of each row; all copies of a document share one."""
    return sharding.assign_shards(docs, weights=40)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard),
]
# Vector prototypes and edit distances have no SQL twin; tests/llm compares the rows with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
