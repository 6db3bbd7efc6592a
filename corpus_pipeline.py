"""From raw documents to shards of a training set, stage by stage.

Every stage takes (spark, docs, sf_dir) and returns the documents it keeps,
with all their columns; the last adds ``shard`` and ``slot``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ticketweave.llm import decontaminate, neardup, quality, queries, sharding
from ticketweave.session import Workspace, temporary_tables

SHARDS = 8
# The network has no SQL form; tests compare the stages' decisions with plain Python.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return quality.keep_quality(docs, queries.table(spark, sf_dir, "labels"))


def minhash_neardup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8."""
    return neardup.drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return decontaminate.remove_contaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose sources, languages and topics follow their target weights."""
    return queries.mixed(docs).filter("kept").select("row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their ``shard`` and ``slot``."""
    return sharding.assign_shards(docs, "doc_id", SHARDS).drop("grown_shard")


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", minhash_neardup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", mix_sources),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again, and deleted when the next one is written."""
    docs = queries.table(spark, sf_dir, "documents")
    work = Workspace(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES):
        with temporary_tables(spark):
            docs = work.write(stage(spark, docs, sf_dir), f"stage-{number}")
        work.drop(f"stage-{number - 1}")
    return docs
