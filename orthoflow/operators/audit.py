"""Provenance audit: source gaps, retrieval batches, freshness and run warnings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Audit warning codes in reporting order.
SOURCE_GAPS = (
    ("missing_source_version", "source_version", False),
    ("missing_model_name", "model_name", True),
    ("missing_model_version", "model_version", True),
    ("missing_annotation_date", "annotation_date", False),
)


def source_warnings(sources: DataFrame) -> DataFrame:
    """Per dataset: sources lacking a fact (plain lists are exempt from model facts), mixed pipelines."""
    plain = F.col("importer_name") == "plain_ko"
    counts = [
        F.count_if(F.col(name).isNull() & (~plain if exempt else F.lit(True))).alias(code)
        for code, name, exempt in SOURCE_GAPS
    ]
    identity = F.struct("source_name", "source_version", "model_name", "model_version")
    facts = sources.groupBy("dataset_id").agg(
        *counts, F.when(F.size(F.collect_set(identity)) > 1, F.count("*")).otherwise(0).alias("mixed_annotation_pipelines"))
    codes = [code for code, _, _ in SOURCE_GAPS] + ["mixed_annotation_pipelines"]
    stacked = ", ".join(f"'{code}', {code}" for code in codes)
    return facts.selectExpr("dataset_id", f"stack({len(codes)}, {stacked}) as (code, affected)").filter("affected > 0")


def batch_warnings(batches: DataFrame) -> DataFrame:
    facts = batches.agg(
        F.count_if(F.col("database_release").isNull()).alias("release_unavailable"),
        F.count_if("is_stale").alias("stale_response"))
    return facts.selectExpr(
        "stack(2, 'release_unavailable', release_unavailable, 'stale_response', stale_response) as (code, affected)").filter("affected > 0")


def quality_warnings(quality: DataFrame) -> DataFrame:
    """Context warnings from declared completeness and contamination percentages."""
    flags = F.array(
        F.when(F.col("completeness") < 100.0, F.lit("incomplete_assembly_context")),
        F.when(F.col("contamination") > 0.0, F.lit("contamination_context")))
    return quality.select("dataset_id", F.explode(flags).alias("code")).filter("code is not null").withColumn(
        "affected", F.lit(1).cast("bigint"))


def retrieval_summary(batches: DataFrame, *by: str) -> DataFrame:
    release = F.array_sort(F.collect_set("database_release"))
    return batches.groupBy(*by).agg(
        F.count("*").alias("batches"),
        F.sum(F.when(F.col("origin") == "network", F.col("attempt_count")).otherwise(0)).alias("network_requests"),
        F.count_if(F.col("origin") == "cache").alias("cache_hits"),
        F.count_if("is_stale").alias("stale_batches"),
        F.sum("response_bytes").alias("response_bytes"),
        F.size(release).cast("bigint").alias("release_count"),
        release.alias("releases"),
        F.min("retrieved_at").alias("first_retrieved"),
        F.max("retrieved_at").alias("last_retrieved"),
    )


def freshness_summary(batches: DataFrame, now) -> DataFrame:
    return batches.agg(
        F.count("*").alias("entries"),
        F.count_if(F.col("expires_at") <= now).alias("expired_entries"),
        F.sum("response_bytes").alias("payload_bytes"))


def dedupe_batches(batches: DataFrame) -> DataFrame:
    """Distinct provenance batches by their full content."""
    return batches.dropDuplicates()


def analysis_warnings(*parts: DataFrame) -> DataFrame:
    """Distinct (position, code) warnings of a run, the earliest position first."""
    return reduce(DataFrame.unionByName, parts).groupBy("code").agg(F.min("position").alias("position"))


def provenance_stale(used: DataFrame, batches: DataFrame, key: str) -> DataFrame:
    """A result is stale when any contributing batch was."""
    return used.select(key, "batch_index").distinct().join(
        batches.select("batch_index", "is_stale"), "batch_index").groupBy(key).agg(F.bool_or("is_stale").alias("is_stale"))
