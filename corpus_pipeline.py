"""The corpus pipeline: documents through language ID, near duplicates, decontamination, mixing and sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's ``docs``. All but the last return the columns of ``documents``.

Defined results: documents without a letter go in the first stage, null and empty texts among them; rows
with null ids take part like others; of rows that repeat id and text one stays; ties between near copies
go to the smallest id, null last; an empty table gives an empty result; very long texts are read whole;
other columns pass through to the mixture.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corridora.llm import decontaminate, jaccard_join, langid, mixing, sharding
from corridora.llm.shared import fold, materialize, release

#: SQL cannot express the Bloom filters, the Newton steps or the permutation; tests compare by brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that identification rejects: those without a letter, and those of whose n-grams no
    language's filter stands out. Without labelled rows only the former go."""
    filters = langid.learn(docs.where(fold("doc_id", 5) != 0))
    if not filters.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = docs.withColumn("__lang", langid.predictor(spark, filters, "text"))
    return found.where((F.col("__lang.lang") != langid.UNDETERMINED) & (F.col("__lang.score") > 0)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of near copies: that of the smallest id."""
    return jaccard_join.one_of_each(docs, words=5, per_cent=75)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item."""
    return decontaminate.remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), n=10)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A shard and slot for every row."""
    return sharding.shard(docs, 16)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("shards", shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        release(before)
    return docs
