"""The corpus pipeline: quality rules, near-duplicates, decontamination, mixing, shards.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns
the rows that it keeps, with the columns of documents; the last adds shard and
slot. Each result is written as Parquet and read again, so a stage starts from a
table that outlives any executor.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import decontaminate, mixing, rules, sharding, simhash
from quillon.llm._common import remove_folder, shared_folder, table

#: Of the documents' tokens, those that the mix holds, in percent; each document at most once.
MIXED_PERCENT = 80
SHARDS = 40


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie outside the fences of their language and source go."""
    return rules.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word Jaccard similarity of 0.8 or more) the document with the smallest doc_id stays."""
    return simhash.deduplicated(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth of the words or more stand in passages of the benchmark go."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by the tree's weights, of MIXED_PERCENT of the tokens."""
    return mixing.mixed_documents(docs, MIXED_PERCENT, 100, max_epochs=1)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its shard and its slot there."""
    return sharding.shard_stage(docs, SHARDS)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("sharded", sharded),
]

#: Near copies (word shingles and their components) can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what lies between two stages goes to the cluster's shared folder.

    A stage's table goes once the next one's is written; the last of them stays, as
    the result reads it.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
            if before:
                remove_folder(spark, before)
            before = f"{folder}/{name}"
    return docs
