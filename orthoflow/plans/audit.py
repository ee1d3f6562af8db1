"""Audit job: evidence, mapping yields, unmapped KOs and source warnings in one long table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthoflow.operators import audit as A
from orthoflow.operators import relations as R
from orthoflow.operators.evidence import accepted_kos
from orthoflow.session import cut_lineage


def audit_annotation(records: DataFrame, relations: DataFrame, sources: DataFrame, audited: tuple[str, ...]) -> DataFrame:
    """(section, dataset_id, item, n). The accepted sets are reduced and checkpointed once, the audited relations too."""
    accepted = cut_lineage(accepted_kos(records, "dataset_id"))
    relations = cut_lineage(relations.filter(F.col("relationship").isin(*audited)))
    parts = [accepted.groupBy("dataset_id").agg(F.count("*").alias("n")).select(
        F.lit("evidence").alias("section"), "dataset_id", F.lit("accepted_unique_kos").alias("item"), "n")]
    measured = R.mapping_yield(R.ko_degrees(accepted, relations, audited), audited)
    parts.append(measured.selectExpr(
        "'mapping' as section", "dataset_id",
        "stack(2, concat(relationship, ':mapped'), mapped_kos, concat(relationship, ':unmapped'), unmapped_kos) as (item, n)"))
    parts.append(A.source_warnings(sources).selectExpr("'warning' as section", "dataset_id", "code as item", "affected as n"))
    without = R.accepted_without_relation(accepted, relations, audited)
    parts.append(without.groupBy("dataset_id").agg(F.count("*").alias("n")).select(
        F.lit("without_relation").alias("section"), "dataset_id", F.lit("any").alias("item"), "n"))
    return reduce(DataFrame.unionByName, parts)
