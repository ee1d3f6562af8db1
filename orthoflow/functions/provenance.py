"""Checks on provenance text, dates, freshness and score consistency."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orthoflow.functions.identifiers import normalize_ko
from orthoflow.functions.text import WHITESPACE, strip

# Schemes of logical source names, zone suffix of a date.
LOGICAL_SCHEMES = ("inline", "mcp", "resource", "urn")
ZONE_PATTERN = r"(?:Z|[+-][0-9]{2}:?[0-9]{2}(?::?[0-9]{2})?)$"
DATE_PATTERN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]{1,6})?)?" + ZONE_PATTERN


def logical_uri_violation(col: Column) -> Column:
    """First rule broken by a logical source name, or NULL when it is fine."""
    scheme = F.lower(F.regexp_extract(col, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    rest = F.when(scheme == "", col).otherwise(F.regexp_extract(col, r"^[^:]*:(.*)$", 1))
    authority = F.regexp_extract(rest, r"^//([^/?#]*)", 1)
    return (
        F.when(col.isNull(), F.lit(None).cast("string"))
        .when((col == "") | (col != strip(col)), F.lit("outer_whitespace_or_empty"))
        .when(col.contains("%"), F.lit("percent_encoded"))
        .when(col.rlike("[" + WHITESPACE.replace(" ", r"\x20") + r"\x00-\x1F\x7F]"), F.lit("whitespace_or_control"))
        .when(col.contains("\\"), F.lit("backslash"))
        .when(col.rlike(r"^(?:[/~]|[A-Za-z]:/)"), F.lit("absolute_path"))
        .when(col.rlike(r"(?:^|/)\.\.?(?:/|$)"), F.lit("path_traversal"))
        .when((scheme != "") & ~scheme.isin(*LOGICAL_SCHEMES), F.lit("unsupported_scheme"))
        .when((scheme == "urn") & (~rest.contains(":") | rest.contains("/")), F.lit("invalid_urn"))
        .when((scheme != "") & (scheme != "urn") & (authority == ""), F.lit("missing_authority"))
        .when((scheme != "") & authority.rlike(r"^[A-Za-z]:$"), F.lit("drive_authority"))
        .when((scheme == "") & col.contains("/"), F.lit("relative_path"))
        .when(authority.contains("@"), F.lit("credentials"))
        .when(col.rlike(r"[?#]."), F.lit("query_or_fragment"))
    )


def absolute_path_violation(col: Column) -> Column:
    """First rule broken by an absolute input path, or NULL when it is fine."""
    return (
        F.when(col.isNull(), F.lit(None).cast("string"))
        .when((col == "") | (col != strip(col)) | col.contains("\0"), F.lit("outer_whitespace_or_empty"))
        .when(~col.startswith("/"), F.lit("not_absolute"))
        .when(col.rlike(r"(?:^|/)\.\.(?:/|$)"), F.lit("path_traversal"))
    )


def parse_annotation_date(col: Column) -> Column:
    """ISO-8601 timestamp that carries a zone; anything else is NULL."""
    with_seconds = F.regexp_replace(col, r"^([^T ]+[T ][0-9]{2}:[0-9]{2})(Z|[+-])", "$1:00$2")
    return F.when(col.rlike(DATE_PATTERN), with_seconds.try_cast("timestamp"))


def freshness_state(expires_at: Column, now: Column) -> Column:
    return F.when(now < expires_at, F.lit("fresh")).otherwise(F.lit("stale"))


def score_violation(raw_ko, ko_id, status, score, score_type, threshold, threshold_rule) -> Column:
    """First consistency rule a record breaks, or NULL."""
    probability = score_type == "probability"
    return (
        F.when(~normalize_ko(raw_ko).eqNullSafe(ko_id), F.lit("ko_not_normalization_of_raw"))
        .when(status.isin("accepted", "rejected") & ko_id.isNull(), F.lit("status_requires_ko"))
        .when((status == "invalid") & ko_id.isNotNull(), F.lit("invalid_with_ko"))
        .when(score.isNotNull() & score_type.isNull(), F.lit("score_without_type"))
        .when(threshold.isNull() != threshold_rule.isNull(), F.lit("threshold_without_rule"))
        .when(probability & ~score.between(0.0, 1.0), F.lit("probability_score_out_of_range"))
        .when(probability & ~threshold.between(0.0, 1.0), F.lit("probability_threshold_out_of_range"))
    )
