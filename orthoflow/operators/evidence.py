"""Evidence views over classified records: accepted and rejected KO sets, record lists, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Records of one KO or sequence are listed in chunks of this many source records, so a KO that holds
# a large share of all records still gives arrays of bounded size.
LIST_CHUNK = 1 << 16


def accepted_rows(records: DataFrame, key: str = "dataset_id") -> DataFrame:
    """Accepted KOs per ``key``, a row per record, for steps that make them distinct themselves."""
    return records.filter("status = 'accepted'").select(key, "ko_id")


def accepted_kos(records: DataFrame, key: str = "dataset_id") -> DataFrame:
    """Distinct accepted KOs per ``key``; at most 100,000 per set by the KO syntax."""
    return accepted_rows(records, key).distinct()


def rejected_kos(records: DataFrame, key: str = "dataset_id") -> DataFrame:
    """Distinct rejected KOs; a KO may be accepted elsewhere as well."""
    return records.filter("status = 'rejected'").select(key, "ko_id").distinct()


def record_lists(numbered: DataFrame, *by: str, chunk: int = LIST_CHUNK) -> DataFrame:
    """Record numbers per group in record order.

    ``list_no`` counts chunks of source records (0 for every dataset below the chunk size), so the
    full list is the concatenation of the group's rows by ``list_no``.
    """
    return (
        numbered.groupBy("dataset_id", *by, F.floor((F.col("record_no") - 1) / chunk).alias("list_no"))
        .agg(F.sort_array(F.collect_list("record_no")).alias("record_nos"), F.count("*").alias("n"))
    )


def records_by_ko(numbered: DataFrame) -> DataFrame:
    return record_lists(numbered.filter("ko_id is not null"), "ko_id")


def records_by_sequence(numbered: DataFrame) -> DataFrame:
    return record_lists(numbered.filter("sequence_id is not null"), "sample_id", "sequence_id")


def analysis_view_summary(parsed: DataFrame, records: DataFrame) -> DataFrame:
    """Compact per-dataset facts kept after row evidence is dropped."""
    parts = (
        records.groupBy("dataset_id").agg(
            F.count("*").alias("assignment_count"),
            F.count_if(F.col("status") == "accepted").alias("accepted_records")),
        accepted_kos(records).groupBy("dataset_id").agg(F.count("*").alias("accepted_unique_kos")),
    )
    summary = parsed.groupBy("dataset_id").agg(
        F.count("*").alias("input_rows"), F.count_if("skipped").alias("skipped_rows"),
        F.sum(F.bit_count("diagnostic_bits")).alias("diagnostic_count"))
    for part in parts:
        summary = summary.join(part, "dataset_id", "left")
    return summary.na.fill(0)


def evidence_audit(records: DataFrame, sources: DataFrame, report: DataFrame) -> DataFrame:
    """Valid, accepted and rejected unique KOs beside the import report counts."""
    per_ko = records.filter("ko_id is not null").groupBy("dataset_id", "ko_id").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("status") == "accepted").alias("a"),
        F.count_if(F.col("status") == "rejected").alias("r"))
    unique = per_ko.groupBy("dataset_id").agg(
        F.sum("n").alias("records_with_valid_ko"),
        F.count("*").alias("unique_valid_kos"),
        F.count_if(F.col("a") > 0).alias("accepted_unique_kos"),
        F.count_if(F.col("r") > 0).alias("rejected_unique_kos"))
    source_counts = sources.groupBy("dataset_id").agg(F.count("*").alias("source_count"))
    return report.join(unique, "dataset_id", "left").join(source_counts, "dataset_id", "left").na.fill(0)
