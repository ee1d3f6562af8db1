"""Pathway denominators and descriptive coverage for requested (set, pathway) pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthoflow.functions import identifiers as I
from orthoflow.operators.spread import PART, copied, dealt, sets_of, target_lists

# Broad class text, broad entry words, warning codes, isolate units.
BROAD_CLASS = "Global and overview maps"
BROAD_ENTRY_PATTERN = r"^\S+\s+(Global|Overview)\s+Pathway$"
ISOLATE_UNITS = ("isolate_genome", "isolate_proteome")
UNIT_WARNINGS = {
    "isolate_genome": "ISOLATE_GENOME_CONTEXT",
    "isolate_proteome": "ISOLATE_PROTEOME_CONTEXT",
    "MAG": "MAG_CONTEXT",
    "pangenome": "PANGENOME_CONTEXT",
    "metagenomic_community": "METAGENOMIC_COMMUNITY_CONTEXT",
    "mixed": "MIXED_CONTEXT",
    "unknown": "UNKNOWN_CONTEXT",
}


def pathway_scope(class_line: Column, entry_line: Column) -> Column:
    """Scope from class and entry text; ``conflict`` when the entry is broad but the class is not."""
    broad_class = F.coalesce(class_line.contains(BROAD_CLASS), F.lit(False))
    broad_entry = F.coalesce(entry_line.rlike(BROAD_ENTRY_PATTERN), F.lit(False))
    return (
        F.when(class_line.isNull() & ~broad_entry, F.lit("missing_class"))
        .when(class_line.isNotNull() & broad_entry & ~broad_class, F.lit("conflict"))
        .when(broad_class | broad_entry, F.lit("global_or_overview"))
        .otherwise(F.lit("standard"))
    )


def link_targets(links: DataFrame) -> DataFrame:
    """Distinct (pathway, target) with row counts and the reason a target is not a denominator KO."""
    target = F.col("target_id")
    ko = F.regexp_extract(target, r"^ko:(K[0-9]{5})$", 1)
    reason = F.when(ko != "", F.lit(None).cast("string")).when(
        target.contains(":") & ~target.startswith("ko:"), F.lit("non_ko_identifier")).otherwise(F.lit("invalid_identifier"))
    return (
        links.filter(F.col("source_id").startswith("path:"))
        .groupBy(I.last_part(F.col("source_id")).alias("pathway_id"), "target_id").agg(F.count("*").alias("rows"))
        .withColumn("ko_id", F.when(ko != "", ko)).withColumn("exclusion_reason", reason)
    )


def pathway_kos(targets: DataFrame) -> DataFrame:
    return targets.filter("ko_id is not null").select("pathway_id", "ko_id")


def pathway_exclusions(targets: DataFrame) -> DataFrame:
    return targets.filter("ko_id is null").select("pathway_id", F.col("target_id").alias("entry"), "exclusion_reason")


def reference_counts(targets: DataFrame) -> DataFrame:
    return targets.groupBy("pathway_id").agg(
        F.sum("rows").alias("relation_rows"),
        F.sum(F.col("rows") - 1).alias("duplicate_rows"),
        F.count("ko_id").alias("reference_kos"),
        F.count_if(F.col("ko_id").isNull()).alias("exclusions"),
    )


def build_reference(pathways: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per pathway: scope, denominator size, exclusions and duplicates (zeros without rows)."""
    return (
        pathways.withColumn("scope", pathway_scope(F.col("class_line"), F.col("entry_line")))
        .join(reference_counts(targets), "pathway_id", "left")
        .na.fill(0, ["relation_rows", "duplicate_rows", "reference_kos", "exclusions"])
    )


def detected_kos(requests: DataFrame, accepted: DataFrame, kos: DataFrame, key: str = "sample_id") -> DataFrame:
    """Accepted KOs inside the denominator of each requested pathway; ``accepted`` may hold repeated rows.

    Starts from the accepted KOs, each with the pathways that hold it; their pairs stay in the task that holds the set.
    """
    holding = kos.groupBy("ko_id").agg(F.collect_list("pathway_id").alias("_pathways"))
    members = sets_of(accepted, key, "ko_id").select(PART, key, F.explode("members").alias("ko_id"))
    pairs = members.join(copied(holding), [PART, "ko_id"]).withColumn("pathway_id", F.explode("_pathways")).drop("_pathways")
    return pairs.join(dealt(requests, key).hint("shuffle_hash"), [PART, key, "pathway_id"]).drop(PART)


def missing_kos(requests: DataFrame, accepted: DataFrame, kos: DataFrame, key: str = "sample_id") -> DataFrame:
    """Denominator KOs of each requested pathway that its set has not accepted; ``accepted`` may hold repeated rows.

    The rows, nearly a product of sets and denominators, are formed from lists in the task that holds the set: a request
    meets its set's list and its pathway's list, and the difference of both is listed row by row.
    """
    denominators = kos.groupBy("pathway_id").agg(F.collect_set("ko_id").alias("_kos"))
    sets = sets_of(accepted, key, "ko_id").withColumnRenamed("members", "_accepted").hint("shuffle_hash")
    asked = dealt(requests.select(key, "pathway_id"), key).join(sets, [PART, key], "left").join(copied(denominators), [PART, "pathway_id"])
    missing = F.array_except("_kos", F.coalesce("_accepted", F.array().cast("array<string>")))
    return asked.select(key, "pathway_id", F.explode(missing).alias("ko_id"))


def coverage(requests: DataFrame, accepted: DataFrame, kos: DataFrame, reference: DataFrame, key: str = "sample_id") -> DataFrame:
    """Coverage of every requested pair; an empty denominator gives a NULL ratio, never 0.

    Hits start from the accepted KOs: a denominator KO that a set has not accepted gives no row. They are counted
    per set and pathway in the tasks before anything is shuffled by that pair; pathways nobody asked for are left out first.
    """
    asked = kos.join(requests.select("pathway_id").distinct(), "pathway_id", "left_semi")
    hits = accepted.join(asked, "ko_id").groupBy(key, "pathway_id").agg(F.count("*").alias("detected_kos"))
    return (
        requests.join(reference, "pathway_id").join(hits, [key, "pathway_id"], "left")
        .na.fill(0, ["detected_kos"])
        .withColumn("missing_kos", F.col("reference_kos") - F.col("detected_kos"))
        .withColumn("coverage_ratio", F.try_divide(F.col("detected_kos"), F.col("reference_kos")))
        .withColumn("evaluation_status", F.when(F.col("reference_kos") > 0, F.lit("evaluated")).otherwise(F.lit("not_evaluable")))
    )


def previews(requests: DataFrame, accepted: DataFrame, kos: DataFrame, limit: int, key: str = "sample_id") -> DataFrame:
    """First ``limit`` detected KOs of each pair with the exact count and a truncation flag.

    Lists are made of all pathways a set has KOs of, and cut, in the task that holds the set; the requested ones follow by a join.
    """
    holding = kos.groupBy("ko_id").agg(F.collect_list("pathway_id").alias("targets")).withColumn(
        "rows", F.transform("targets", lambda _: F.lit(1).cast("bigint")))
    pairs = dealt(accepted.select(key, "ko_id"), key, "ko_id").join(copied(holding), [PART, "ko_id"])
    listed = target_lists(pairs, key, limit).withColumnsRenamed({"target_id": "pathway_id", "ko_ids": "preview", "detected_kos": "n"})
    return requests.select(key, "pathway_id").distinct().join(listed, [key, "pathway_id"]).select(
        key, "pathway_id", "preview", "n", (F.col("n") > limit).alias("truncated"))


def eligibility(pairs: DataFrame, allow_broad: bool = False) -> DataFrame:
    """Reason a (set, pathway) pair may not be evaluated, or NULL.

    Expects ``reference_namespace, requested_namespace, scope, analysis_unit, organism_code,
    gene_context_code, pathway_organism_code``.
    """
    organism = F.col("reference_namespace") == "organism"
    same_code = (F.col("pathway_organism_code") == F.col("organism_code")) & (
        F.col("pathway_organism_code") == F.col("gene_context_code"))
    reason = (
        F.when(F.col("reference_namespace") != F.col("requested_namespace"), F.lit("namespace_mismatch"))
        .when((F.col("scope") == "global_or_overview") & F.lit(not allow_broad), F.lit("broad_reference_needs_opt_in"))
        .when(organism & F.col("gene_context_code").isNull(), F.lit("missing_gene_context"))
        .when(organism & ~F.col("analysis_unit").isin(*ISOLATE_UNITS), F.lit("unit_not_isolate"))
        .when(organism & ~F.coalesce(same_code, F.lit(False)), F.lit("organism_code_mismatch"))
    )
    return pairs.withColumn("rejection", reason)


def warning_codes(preview_limit: int) -> Column:
    """Ordered warning codes of one coverage row (with ``is_stale`` and ``analysis_unit``)."""
    unit = F.coalesce(*[F.when(F.col("analysis_unit") == name, F.lit(code)) for name, code in UNIT_WARNINGS.items()])
    return F.array_compact(F.array(
        F.lit("DESCRIPTIVE_RATIO"),
        F.when(F.col("reference_kos") == 0, F.lit("NO_REFERENCE_KOS")),
        F.when(F.col("scope") == "global_or_overview", F.lit("GLOBAL_OR_OVERVIEW_REFERENCE")),
        F.when(F.col("is_stale"), F.lit("STALE_REFERENCE")),
        F.when(F.col("exclusions") > 0, F.lit("REFERENCE_EXCLUSIONS")),
        F.when(F.col("duplicate_rows") > 0, F.lit("DUPLICATE_RELATIONSHIPS")),
        unit,
        F.when(F.col("detected_kos") > preview_limit, F.lit("DETECTED_PREVIEW_TRUNCATED")),
        F.when(F.col("missing_kos") > preview_limit, F.lit("MISSING_PREVIEW_TRUNCATED")),
        F.when(F.col("exclusions") > preview_limit, F.lit("EXCLUSION_PREVIEW_TRUNCATED")),
    ))


def stale_pathways(links: DataFrame, batches: DataFrame) -> DataFrame:
    """Whether any batch behind a pathway's rows was stale."""
    used = links.select(I.last_part(F.col("source_id")).alias("pathway_id"), "batch_index").distinct()
    return used.join(batches.select("batch_index", "is_stale"), "batch_index").groupBy("pathway_id").agg(
        F.bool_or("is_stale").alias("is_stale"))


def canonical_pathways(requests: DataFrame, key: str) -> DataFrame:
    """First-seen pathway specs per ``key``: paired ``ko``/``map`` ids collapse, the ko view wins.

    Expects ``position`` and ``pathway_id``; keeps the position of the first spec of each group.
    """
    namespace = I.pathway_namespace(F.col("pathway_id"))
    group = F.when(namespace == "organism", F.concat(F.lit("organism:"), F.col("pathway_id"))).otherwise(
        F.concat(F.lit("reference:"), F.right(F.col("pathway_id"), F.lit(5))))
    prefer = F.struct((namespace != "ko").alias("not_ko"), F.col("position"), F.col("pathway_id"))
    return (
        requests.filter(namespace.isNotNull()).groupBy(key, group.alias("pathway_group"))
        .agg(F.min("position").alias("position"), F.min(prefer)["pathway_id"].alias("pathway_id"))
    )
