"""Relation rows joined with accepted KO sets: ranking, yields and degrees.

Sets are keyed by ``key`` (a sample or a dataset). A KO set has at most 100,000 members, and rows are
reduced to distinct (set, target, ko) by partial aggregation before anything is collected per target.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orthoflow.functions import identifiers as I
from orthoflow.operators.spread import PART, copied, dealt, target_lists

# Global and overview maps left out of automatic selection; selection bounds.
BROAD_PATHWAYS = (
    "ko01100", "ko01110", "ko01120", "ko01200", "ko01210", "ko01212", "ko01220",
    "ko01230", "ko01232", "ko01240", "ko01250", "ko01310", "ko01320",
)
DEFAULT_TOP_N = 5

TargetNormalizer = Callable[[Column], Column]


def pathway_target(raw: Column) -> Column:
    """``ko`` or ``map`` pathway target as its shared ``ko`` id; other namespaces are NULL."""
    value = I.last_part(raw)
    return F.when(I.pathway_namespace(value).isin("ko", "map"), I.canonical_pathway_id(value))


def module_target(raw: Column) -> Column:
    value = I.last_part(raw)
    namespace = F.when(raw.contains(":"), F.substring_index(raw, ":", 1)).otherwise(F.lit("module"))
    return F.when(value.rlike(r"^M[0-9]{5}$") & namespace.isin("md", "module"), value)


def plain_target(raw: Column) -> Column:
    return I.last_part(raw)


NORMALIZERS: dict[str, TargetNormalizer] = {
    "ko_to_pathway": pathway_target,
    "ko_to_module": module_target,
}


def normalized_relations(relations: DataFrame, relationship: str, normalize: TargetNormalizer | None = None) -> DataFrame:
    """Rows of one relationship with ``ko_id`` and ``target_id``; incompatible ids give NULL there."""
    normalize = normalize or NORMALIZERS.get(relationship, plain_target)
    return relations.filter(F.col("relationship") == relationship).select(
        I.normalize_ko(I.last_part(F.col("source_id"))).alias("ko_id"),
        normalize(F.col("target_id")).alias("target_id"),
        F.col("target_id").alias("raw_target"),
        "batch_index", "line_number",
    )


def incompatible_relations(normalized: DataFrame) -> DataFrame:
    """Rows a strict caller treats as an error."""
    return normalized.filter("ko_id is null or target_id is null")


def usable_relations(normalized: DataFrame) -> DataFrame:
    return normalized.filter("ko_id is not null and target_id is not null")


def accepted_relations(accepted: DataFrame, normalized: DataFrame) -> DataFrame:
    """Relation rows whose source is an accepted KO of the set."""
    return accepted.join(usable_relations(normalized), "ko_id")


def ranked_overlap(accepted: DataFrame, normalized: DataFrame, key: str = "sample_id", limit: int | None = None) -> DataFrame:
    """Distinct accepted KOs, their list (the first ``limit``), the raw relation rows and the rank per target.

    Repeated relation rows are counted first. The pairs of accepted KOs and targets stay in the task that holds their
    set (:mod:`spread`); a set's targets are ranked there by distinct KOs, then id.
    """
    edges = normalized.filter("ko_id is not null and target_id is not null").groupBy("ko_id", "target_id").agg(F.count("*").alias("rows"))
    held = edges.groupBy("ko_id").agg(F.collect_list(F.struct("target_id", "rows")).alias("held")).select(
        "ko_id", F.col("held.target_id").alias("targets"), F.col("held.rows").alias("rows"))
    pairs = dealt(accepted.select(key, "ko_id").filter("ko_id is not null"), key, "ko_id").join(copied(held), [PART, "ko_id"])
    return target_lists(pairs, key, limit)


def target_overlap(accepted: DataFrame, normalized: DataFrame, key: str = "sample_id") -> DataFrame:
    """:func:`ranked_overlap` without the rank."""
    return ranked_overlap(accepted, normalized, key).drop("rank")


def rank_targets(overlap: DataFrame, key: str = "sample_id") -> DataFrame:
    """Ranks 1..n by distinct KOs, then id. One row per target, so the window stays small."""
    order = W.partitionBy(key).orderBy(F.desc("detected_kos"), "target_id")
    return overlap.withColumn("rank", F.row_number().over(order))


def top_targets(ranked: DataFrame, n: int = DEFAULT_TOP_N, excluded: tuple[str, ...] = (), key: str = "sample_id",
                limit: int | None = None) -> DataFrame:
    """First ``n`` ranked targets after leaving out ``excluded``; the original rank is kept. ``limit`` bounds ``n`` where a caller wants that."""
    if n < 1 or (limit is not None and n > limit):
        raise ValueError(f"n must be at least 1 and at most {limit}")
    kept = ranked.filter(~F.col("target_id").isin(*excluded)) if excluded else ranked
    order = W.partitionBy(key).orderBy("rank")
    return kept.withColumn("selection", F.row_number().over(order)).filter(F.col("selection") <= n)


def ko_degrees(accepted: DataFrame, relations: DataFrame, relationships: tuple[str, ...]) -> DataFrame:
    """Distinct targets and raw rows of every accepted KO under each relationship, zero where it has none.

    The relations are read once for all relationships, reduced to one row per KO with a pair of columns for
    each (``targets_i``, ``rows_i``), and joined once.
    """
    kept = relations.filter(F.col("relationship").isin(*relationships))
    target = F.coalesce(*[F.when(F.col("relationship") == name, NORMALIZERS.get(name, plain_target)(F.col("target_id"))) for name in relationships])
    edges = kept.select("relationship", I.normalize_ko(I.last_part(F.col("source_id"))).alias("ko_id"), target.alias("target")).filter(
        "ko_id is not null and target is not null").groupBy("relationship", "ko_id", "target").agg(F.count("*").alias("rows"))
    mine = [F.col("relationship") == name for name in relationships]
    degrees = edges.groupBy("ko_id").agg(
        *[F.count_if(m).alias(f"targets_{i}") for i, m in enumerate(mine)], *[F.sum(F.when(m, F.col("rows")).otherwise(0)).alias(f"rows_{i}") for i, m in enumerate(mine)])
    return accepted.join(degrees, "ko_id", "left").na.fill(0, [c for c in degrees.columns if c != "ko_id"])


def mapping_yield(degrees: DataFrame, relationships: tuple[str, ...], key: str = "dataset_id") -> DataFrame:
    """One row per set and relationship, from one aggregate over the accepted KOs."""
    parts = []
    for i, _ in enumerate(relationships):
        targets, rows = F.col(f"targets_{i}"), F.col(f"rows_{i}")
        parts.append(F.struct(F.count_if(targets > 0).alias("mapped_kos"), F.sum(rows).alias("raw_relation_rows"), F.sum(targets).alias("unique_relations"),
                              F.count_if(targets > 1).alias("one_to_many_kos")).alias(f"part_{i}"))
    wide = degrees.groupBy(key).agg(F.count("*").alias("selected_kos"), *parts)
    rows = F.array(*[F.struct(
        F.lit(name).alias("relationship"), *[F.col(f"part_{i}.{c}").alias(c) for c in ("mapped_kos", "raw_relation_rows", "unique_relations", "one_to_many_kos")])
        for i, name in enumerate(relationships)])
    return wide.select(key, "selected_kos", F.inline(rows)).select(
        "relationship", key, "selected_kos", "mapped_kos", (F.col("selected_kos") - F.col("mapped_kos")).alias("unmapped_kos"),
        F.try_divide("mapped_kos", "selected_kos").alias("mapping_yield"), "raw_relation_rows", "unique_relations", "one_to_many_kos")


def target_degree_distribution(degrees: DataFrame, relationships: tuple[str, ...], key: str = "dataset_id") -> DataFrame:
    rows = F.array(*[F.struct(F.lit(name).alias("relationship"), F.col(f"targets_{i}").alias("target_count")) for i, name in enumerate(relationships)])
    return degrees.select(key, F.inline(rows)).filter("target_count > 0").groupBy("relationship", key, "target_count").agg(F.count("*").alias("ko_count"))


def accepted_without_relation(accepted: DataFrame, relations: DataFrame, relationships: tuple[str, ...]) -> DataFrame:
    """Accepted KOs with no row in any audited relation."""
    sources = relations.filter(F.col("relationship").isin(*relationships)).select(
        I.normalize_ko(I.last_part(F.col("source_id"))).alias("ko_id")).distinct()
    return accepted.join(sources, "ko_id", "left_anti")
