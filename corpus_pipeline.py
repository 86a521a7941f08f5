"""The corpus pipeline: reject toxic documents, keep one of near duplicates, drop
documents that hold benchmark items, mix the sources to their weights and shard.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written
as Parquet and read again as the documents of the next stage. Working tables lie in the
folder that ``spark.checkpoint.dir`` names; the result of a stage is deleted when the next
one is written, except the one that the last stage reads.

Rows with null or empty texts pass all filters; the mix takes nothing of them, as they
have no words. Of copies and near copies the row with the smallest id stays, and of
rows that repeat this id all; rows without an id stay where no row of their group has one.
Of ties the smallest id decides. All but the last stage return the columns of the
documents, whatever their names; an empty table passes as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, mixing, near_dedup, sharding, toxicity
from tidemark.llm._common import Scratch

#: At most about so many labelled rows are read to learn the toxic terms.
SAMPLE_ROWS = 20_000


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic."""
    return toxicity.reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), SAMPLE_ROWS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (5-word shingles, similarity 0.8 or more)."""
    return near_dedup.keep_one(docs, size=5, percent=80)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return decontaminate.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix 1 : 2 : 3 takes their words."""
    return mixing.apply_mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row."""
    return sharding.kd_shards(docs, 8)


STAGES = [
    ("toxicity", toxic),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("mixing", mixture),
    ("sharding", shards),
]

#: No SQL: the stages learn from data, hash texts and compare them by edit distance.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over the documents of ``sf_dir``."""
    docs, scratch, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark), None
    for _, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
