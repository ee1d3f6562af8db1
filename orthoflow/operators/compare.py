"""Comparison of labelled KO sets and of outcomes computed for them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Warning codes in reporting order.
ALWAYS = ("DETERMINISTIC_SET_DIFFERENCE_ONLY", "ANNOTATION_ABSENCE_NOT_BIOLOGICAL_ABSENCE")
UNIT_RULES = (
    ("UNKNOWN_OR_MIXED_ANALYSIS_UNIT", ("unknown", "mixed")),
    ("POOLED_COMMUNITY_POTENTIAL", ("metagenomic_community",)),
    ("POOLED_PANGENOME_POTENTIAL", ("pangenome",)),
    ("MAG_QUALITY_SENSITIVE", ("MAG",)),
)
SOURCE_IDENTITY = ("source_name", "source_version", "model_name", "model_version", "importer_name", "importer_version")


def check_one_policy(inputs: DataFrame) -> DataFrame:
    """Number of policies among the inputs; a comparison needs exactly one."""
    return inputs.agg(
        F.count("*").alias("input_count"),
        F.count_distinct("policy_name", "policy_version").alias("policy_count"),
    ).withColumn("comparable", (F.col("policy_count") == 1) & (F.col("input_count") >= 2))


def require_one_policy(inputs: DataFrame) -> int:
    """The number of policies (1); raises when inputs differ in policy or are fewer than two. One row is fetched."""
    found = check_one_policy(inputs).first()
    if not found["comparable"]:
        raise ValueError(f"a comparison needs two or more inputs of one policy: {found['input_count']} inputs, {found['policy_count']} policies")
    return found["policy_count"]


def membership(sets: DataFrame) -> DataFrame:
    """(ko_id, members): the sorted input indexes that hold each KO. Inputs are few (2 to 100)."""
    return sets.groupBy("ko_id").agg(F.sort_array(F.collect_set("input_index")).alias("members"))


def ko_union(sets: DataFrame) -> DataFrame:
    return sets.select("ko_id").distinct()


def with_input_count(members: DataFrame, inputs: DataFrame) -> DataFrame:
    """Attach the number of compared inputs: a one-row aggregate on a constant key."""
    total = inputs.agg(F.count("*").alias("input_count")).withColumn("one", F.lit(1))
    return members.withColumn("one", F.lit(1)).join(F.broadcast(total), "one").drop("one")


def shared_by_all(sets: DataFrame, inputs: DataFrame) -> DataFrame:
    """KOs every input holds; ``sets`` has one row per (input, KO)."""
    counts = with_input_count(sets.groupBy("ko_id").agg(F.count("*").alias("n")), inputs)
    return counts.filter("n = input_count").select("ko_id")


def set_specific(sets: DataFrame) -> DataFrame:
    """KOs exactly one input holds."""
    return sets.groupBy("ko_id").agg(F.count("*").alias("n"), F.min("input_index").alias("input_index")).filter(
        "n = 1").select("input_index", "ko_id")


def partial_patterns(members: DataFrame) -> DataFrame:
    """KOs grouped by the exact inputs holding them, for 1 < size < n."""
    inside = members.filter((F.size("members") > 1) & (F.size("members") < F.col("input_count")))
    return inside.groupBy("members").agg(F.sort_array(F.collect_list("ko_id")).alias("ko_ids"), F.count("*").alias("n"))


def compare_ko_sets(sets: DataFrame, inputs: DataFrame) -> DataFrame:
    """Full partition: every KO with its part (shared, specific, partial) and members."""
    members = with_input_count(membership(sets), inputs)
    part = (
        F.when(F.size("members") == F.col("input_count"), F.lit("shared_by_all"))
        .when(F.size("members") == 1, F.lit("set_specific")).otherwise(F.lit("partially_shared"))
    )
    return members.select("ko_id", part.alias("part"), "members")


def summarize_comparison(partition: DataFrame, preview: int) -> DataFrame:
    """Exact size and bounded preview of every part and membership pattern (at most 100,000 KOs)."""
    grouped = partition.groupBy("part", "members").agg(F.sort_array(F.collect_list("ko_id")).alias("ko_ids"))
    return grouped.select(
        "part", "members", F.size("ko_ids").cast("bigint").alias("n"), F.slice("ko_ids", 1, preview).alias("preview"),
        (F.size("ko_ids") > preview).alias("truncated"))


def dataset_provenance(inputs: DataFrame, records: DataFrame, sets: DataFrame) -> DataFrame:
    """Per input: records, unique accepted KOs, and how many sample labels it pools."""
    samples = records.groupBy("dataset_id", "sample_id").agg(F.count("*").alias("n"))
    counts = samples.groupBy("dataset_id").agg(F.sum("n").alias("record_count"), F.count("*").alias("sample_count"))
    unique = sets.groupBy("input_index").agg(F.count("*").alias("unique_kos"))
    return inputs.select("dataset_id", "input_index").join(counts, "dataset_id", "left").join(
        unique, "input_index", "left").na.fill(0)


def sample_labels(records: DataFrame) -> DataFrame:
    """Sample labels of each dataset with the source position where they are first seen."""
    return records.groupBy("dataset_id", "sample_id").agg(F.min(F.struct("row_number", "pos")).alias("first_seen")).select(
        "dataset_id", "sample_id", F.col("first_seen.row_number").alias("first_row"))


def source_signatures(sources: DataFrame) -> DataFrame:
    """Fingerprint of each dataset's source identities as a multiset.

    Count, sum and xor of two hashes combine map-side, so a dataset with very many sources is never
    listed in one place.
    """
    identity = [F.coalesce(F.col(name), F.lit("\0")) for name in SOURCE_IDENTITY]
    hashed = sources.withColumns({"h": F.xxhash64(*identity), "g": F.xxhash64(F.lit("second"), *identity)})
    return hashed.groupBy("dataset_id").agg(
        F.concat_ws(":", F.count("*"), F.sum(F.col("h").cast("decimal(38,0)")), F.bit_xor("g")).alias("signature"))


def comparison_warnings(inputs: DataFrame, sources: DataFrame, records: DataFrame) -> DataFrame:
    """Warning codes with the affected input indexes (empty means the whole comparison)."""
    pooled = records.groupBy("dataset_id").agg(
        (F.min("sample_id") != F.max("sample_id")).alias("multi_sample"))
    facts = inputs.join(source_signatures(sources), "dataset_id", "left").join(pooled, "dataset_id", "left").select(
        "input_index", F.coalesce("signature", F.lit("")).alias("signature"), "analysis_unit",
        F.struct("taxon_id", "organism_code").alias("context"), F.coalesce("multi_sample", F.lit(False)).alias("multi_sample"))
    everyone = F.sort_array(F.collect_list("input_index"))

    def where(condition: Column) -> Column:
        return F.sort_array(F.collect_list(F.when(condition, F.col("input_index"))))

    def differing(distinct: Column) -> Column:
        return F.when(distinct > 1, everyone)

    def listed(condition: Column) -> Column:
        return F.when(F.size(where(condition)) > 0, where(condition))

    nothing = F.array().cast("array<bigint>")
    items = [(code, nothing) for code in ALWAYS]
    items += [
        ("ANNOTATION_PIPELINE_MISMATCH", differing(F.size(F.collect_set("signature")))),
        ("ANALYSIS_UNIT_MISMATCH", differing(F.size(F.collect_set("analysis_unit")))),
        ("TAXONOMIC_CONTEXT_MISMATCH", differing(F.size(F.collect_set("context")))),
    ]
    items += [(code, listed(F.col("analysis_unit").isin(*units))) for code, units in UNIT_RULES]
    items.append(("MULTI_SAMPLE_DATASET", listed(F.col("multi_sample"))))
    packed = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(code).alias("code"), value.alias("affected"))
                       for i, (code, value) in enumerate(items)])
    return facts.agg(packed.alias("w")).select(F.inline("w")).filter("affected is not null")


def compare_outcomes(outcomes: DataFrame, target: str, signature: tuple[str, ...], status: str) -> DataFrame:
    """Per target: whether the signatures differ across inputs, and the inputs of every status."""
    return outcomes.groupBy(target).agg(
        F.count("*").alias("compared_inputs"),
        (F.size(F.collect_set(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in signature]))) > 1).alias("outcomes_differ"),
        *[F.array_join(F.sort_array(F.collect_list(F.when(F.col(status) == name, F.col("input_index")))).cast("array<string>"), ";").alias(
            f"{name}_in") for name in STATUS_NAMES[status]],
    )


STATUS_NAMES = {
    "evaluation_status": ("evaluated", "not_evaluable"),
    "module_status": ("complete", "incomplete", "partially_evaluable", "not_evaluable"),
}


def long_table(**parts: DataFrame) -> DataFrame:
    """Several small results under one (section, item, value) schema."""
    return reduce(DataFrame.unionByName, [frame.withColumn("section", F.lit(name)) for name, frame in parts.items()])
