"""Documents to a training mix: reject, deduplicate, decontaminate, interleave.

Every stage takes the documents the stage before kept and returns the columns of ``documents``; the last adds
the place in the mix. Rows that a stage drops are gone for the next ones. Null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orthoflow.llm import decontaminate, exact_dedup, mixing, near_dedup, quality
from orthoflow.llm.common import materialise, read_table, unused


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labelled documents, keep the rows whose score reaches the threshold."""
    model = quality.train(docs, read_table(spark, sf_dir, "labels"))
    score = unused(docs, "_score")
    return quality.scored(docs, model, score).filter(F.col(score) >= quality.THRESHOLD).drop(score)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more."""
    return near_dedup.one_of_each(docs, width=5, num=4, den=5)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark", "item_id", "text"))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their place in the mix to the sources' weights: slot, block and place; written in that order."""
    return mixing.mix_sources(docs).orderBy("slot", "place")


STAGES = [
    ("quality", reject_low_quality),
    ("exact", drop_exact_copies),
    ("near", drop_near_copies),
    ("benchmark", drop_benchmark_copies),
    ("mix", mix_to_weights),
]

#: The classifier cannot be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
