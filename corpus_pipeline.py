"""The corpus pipeline: five stages over ``documents``, each one of the operators of corpuscle.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm import decontamination, minhash, mixing, sharding, toxicity
from corpuscle.llm.common import staged


# All stages: null ids and texts, empty and very long texts, repeated rows and empty tables go
# through as the operators define it, and the columns of ``docs`` come out as they went in.


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the multiple-instance model rejects go. Null texts and texts without words
    have score 0 and stay; repeated rows stay or go together; without labels all stay."""
    weights = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, weights)
    predicted = scored.columns[-2]
    return scored.where(F.col(predicted) == 0).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, that of the smallest id (of rows that
    repeat it one). Null texts and texts without words are nobody's duplicate and stay."""
    return minhash.unique(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. Null texts and texts without words
    stay; without items all stay."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, whole, as often as its source's target asks for: not at all, once, or up to
    three times. Null texts and texts without words are never taken; a null source is one."""
    mixed = mixing.mix(docs, whole_documents=True)
    return mixed.select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row of the mix; null texts count as empty, repetitions of a text are
    a group."""
    return sharding.shard_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The signatures, the fitted weights and the label propagation can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
