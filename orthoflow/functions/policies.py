"""Named decision policies: each returns one struct<status, reason> Column.

A policy is a function from evidence columns to such a struct, so a user can register another one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from orthoflow.functions.text import is_blank, strip

# Statuses, score semantics and input formats.
STATUSES = ("accepted", "rejected", "unclassified", "invalid")
SCORE_TYPES = ("probability", "bitscore", "e_value", "source_specific")
THRESHOLD_RULES = ("gte", "lte", "source_specific")
FORMATS = ("plain_ko", "generic_csv", "generic_tsv", "detailed_csv")


@dataclass(frozen=True)
class Evidence:
    """Columns a policy may look at."""

    raw_ko: Column
    ko_id: Column
    raw_decision: Column
    score: Column
    threshold: Column
    score_type: Column
    threshold_rule: Column


@dataclass(frozen=True)
class Policy:
    name: str
    version: str
    formats: tuple[str, ...]
    classify: Callable[[Evidence], Column]


def outcome(status: str, reason: str) -> Column:
    return F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))


def no_evidence(raw_ko: Column, ko_id: Column) -> Evidence:
    text, number = F.lit(None).cast("string"), F.lit(None).cast("double")
    return Evidence(raw_ko, ko_id, text, number, number, text, text)


def _user_supplied(e: Evidence) -> Column:
    return F.when(e.ko_id.isNull(), outcome("invalid", "invalid_ko_identifier")).otherwise(
        outcome("accepted", "user_supplied_annotation")
    )


def _source_status(e: Evidence) -> Column:
    decision = F.lower(strip(F.coalesce(e.raw_decision, F.lit(""))))
    return (
        F.when(e.ko_id.isNull() & is_blank(e.raw_ko), outcome("unclassified", "missing_ko_prediction"))
        .when(e.ko_id.isNull(), outcome("invalid", "invalid_ko_identifier"))
        .when(decision == "accepted", outcome("accepted", "source_accepted"))
        .when(decision == "rejected", outcome("rejected", "source_rejected"))
        .when(decision == "unclassified", outcome("unclassified", "source_unclassified"))
        .otherwise(outcome("unclassified", "unrecognized_source_decision"))
    )


def _marker_threshold(e: Evidence) -> Column:
    marker = F.coalesce(e.raw_decision, F.lit(""))
    wrong_semantics = ~F.coalesce(
        (e.score_type == "probability") & (e.threshold_rule == "gte"), F.lit(False)
    )
    return (
        F.when(e.ko_id.isNull() & is_blank(e.raw_ko), outcome("unclassified", "missing_ko_prediction"))
        .when(e.ko_id.isNull(), outcome("invalid", "invalid_ko_identifier"))
        .when(marker == "*", outcome("accepted", "source_acceptance_marker"))
        .when(marker != "", outcome("unclassified", "unrecognized_source_decision"))
        .when(e.score.isNull() | e.threshold.isNull(), outcome("unclassified", "insufficient_decision_evidence"))
        .when(wrong_semantics, outcome("unclassified", "incompatible_score_semantics"))
        .when(e.score >= e.threshold, outcome("accepted", "meets_source_threshold"))
        .otherwise(outcome("rejected", "below_source_threshold"))
    )


POLICIES = {
    "user_supplied": Policy("user_supplied", "1", ("plain_ko", "generic_csv", "generic_tsv"), _user_supplied),
    "source_status": Policy("source_status", "2", ("generic_csv", "generic_tsv"), _source_status),
    "marker_threshold": Policy("marker_threshold", "1", ("detailed_csv",), _marker_threshold),
}


def register_policy(policy: Policy) -> None:
    POLICIES[policy.name] = policy


def policy_for(name: str, input_format: str) -> Policy:
    """Look a policy up and refuse a format it does not declare, before anything is planned."""
    policy = POLICIES[name]
    if input_format not in policy.formats:
        raise ValueError(f"policy {name} does not support {input_format}")
    return policy


def marker_threshold_conflict(marker: Column, score: Column, threshold: Column) -> Column:
    return F.coalesce((marker == "*") & (score < threshold), F.lit(False))
