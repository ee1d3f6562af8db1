"""Comparison of two reference snapshots and selection from one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthoflow.session import cut_lineage

# Change dimensions, list fields that state relations.
DIMENSIONS = ("entry_fields", "relationships", "module_definitions", "pathway_denominators")
RELATION_FIELDS = (
    "modules", "pathways", "reactions", "compounds", "glycans", "orthology", "ec_numbers", "enzyme_ids",
    "ko_identifiers", "rclass_ids", "reaction_ids", "compound_ids", "glycan_ids",
)
ENTRY = ["database", "identifier"]


def sided(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.withColumn("is_left", F.lit(True)).unionByName(right.withColumn("is_left", F.lit(False)))


def _change_type() -> Column:
    return F.when(~F.col("in_left"), F.lit("entry_added")).otherwise(F.lit("entry_removed"))


def entry_added_removed(left: DataFrame, right: DataFrame) -> DataFrame:
    """Entries on one side only, by one aggregate over both sides."""
    held = sided(left.select(*ENTRY), right.select(*ENTRY)).groupBy(*ENTRY).agg(
        F.bool_or("is_left").alias("in_left"), F.bool_or(~F.col("is_left")).alias("in_right"))
    return held.filter("in_left <> in_right").select(*ENTRY, _change_type().alias("change_type"))


def compared_fields(side: DataFrame) -> Column:
    """Whether a field takes part in the comparison: a module's definition text does not, its parsed form does."""
    return ~((F.col("database") == "module") & (F.col("field") == "definition"))


def differing_entries(left: DataFrame, right: DataFrame) -> DataFrame:
    """(entry, in_left, in_right) of entries on one side only or with different digests.

    A digest is the number of fields, the xor of one hash of every (field, items) and the sum of another: 128
    bits that do not depend on the order of the fields. Only these leave the tasks, combined by entry.
    """
    used = compared_fields(left)
    # A hash passes over nulls, so where they stand is hashed as well.
    nulls = F.transform("items", lambda x: x.isNull())
    one, two = (F.xxhash64(F.lit(seed), "field", "items", F.col("items").isNull(), nulls) for seed in (1, 2))
    both = sided(left, right).select(*ENTRY, "is_left", F.when(used, one).alias("one"), F.when(used, F.pmod(two, F.lit(1 << 40))).alias("two"))

    def digest(is_left: bool) -> list[Column]:
        mine = F.col("is_left") == is_left
        return [F.count_if(mine), F.count(F.when(mine, F.col("one"))), F.bit_xor(F.when(mine, F.col("one"))), F.sum(F.when(mine, F.col("two")))]

    parts = [part.alias(f"{side}{k}") for side, flag in (("l", True), ("r", False)) for k, part in enumerate(digest(flag))]
    equal = F.col("l1") == F.col("r1")
    for k in (2, 3):
        equal = equal & F.col(f"l{k}").eqNullSafe(F.col(f"r{k}"))
    in_left, in_right = F.col("l0") > 0, F.col("r0") > 0
    return both.groupBy(*ENTRY).agg(*parts).filter(~(in_left & in_right & equal)).select(*ENTRY, in_left.alias("in_left"), in_right.alias("in_right"))


def check_scopes(left: DataFrame, right: DataFrame) -> None:
    """Refuse snapshots that were asked for different entries: a missing entry would look like a removed one."""
    counts = sided(left.select(*ENTRY).distinct(), right.select(*ENTRY).distinct()).groupBy(*ENTRY).agg(
        F.bool_or("is_left").alias("l"), F.bool_or(~F.col("is_left")).alias("r")).agg(
        F.count_if("l").alias("l"), F.count_if("r").alias("r"), F.count_if(F.col("l") != F.col("r")).alias("n")).first()
    if counts["n"]:
        raise ValueError(f"the snapshots cover different requested entries ({counts['l']} and {counts['r']}, {counts['n']} on one side only)")


def field_category(database: Column, field: Column) -> Column:
    return (
        F.when((database == "module") & (field == "module_definition"), F.lit("module_definitions"))
        .when((database == "pathway") & (field == "ko_identifiers"), F.lit("pathway_denominators"))
        .when(field.isin(*RELATION_FIELDS), F.lit("relationships"))
        .otherwise(F.lit("entry_fields"))
    )


def array_added_removed(left: Column, right: Column) -> tuple[Column, Column]:
    """Members only in the right list, members only in the left list, both sorted."""
    empty = F.array().cast("array<string>")
    l, r = F.coalesce(left, empty), F.coalesce(right, empty)
    return F.array_sort(F.array_except(r, l)), F.array_sort(F.array_except(l, r))


def merged_fields(fields: DataFrame) -> DataFrame:
    """One row per entry and field: the distinct lists of its cards, sorted and joined; NULL where none has a list."""
    joined = F.flatten(F.array_sort(F.collect_set("items")))
    return fields.groupBy(*ENTRY, "field").agg(F.when(F.count("items") > 0, joined).alias("items"))


def snapshot_diff(left: DataFrame, right: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS,
                  parser_compatible: bool = True, scopes: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Changes between two long card tables (database, identifier, field, items).

    Membership changes always; field changes of shared entries only for the chosen dimensions and
    only when both snapshots come from the same parser version. With ``scopes``, the requested entries of each
    side, snapshots of different scopes are refused.

    Entries are compared by digests first (one scan a side); the items of entries that differ are read in a second one.
    A field that several cards of one entry hold counts once, with their distinct lists joined in order.
    """
    if scopes is not None:
        check_scopes(*scopes)
    empty = F.array().cast("array<string>")
    differing = cut_lineage(differing_entries(left, right))
    membership = differing.filter("in_left <> in_right").select(
        *ENTRY, F.lit(None).cast("string").alias("field"), F.lit("entry_membership").alias("category"), _change_type().alias("change_type"),
        empty.alias("added"), empty.alias("removed"))
    if not parser_compatible:
        return membership
    changed = differing.filter("in_left AND in_right").select(*ENTRY)
    l, r = (merged_fields(side.filter(compared_fields(side)).join(changed, ENTRY, "left_semi")).withColumnRenamed("items", name)
            for side, name in ((left, "left_items"), (right, "right_items")))
    both = l.join(r, [*ENTRY, "field"], "full").filter(~F.col("left_items").eqNullSafe(F.col("right_items")))
    added, removed = array_added_removed(F.col("left_items"), F.col("right_items"))
    change = F.when(F.col("left_items").isNull(), F.lit("field_added")).when(
        F.col("right_items").isNull(), F.lit("field_removed")).otherwise(F.lit("field_modified"))
    fields = both.select(*ENTRY, "field", field_category(F.col("database"), F.col("field")).alias("category"),
                         change.alias("change_type"), added.alias("added"), removed.alias("removed"))
    return membership.unionByName(fields.filter(F.col("category").isin(*dimensions)))


def dimension_counts(diff: DataFrame) -> DataFrame:
    """Field changes and changed entries per dimension, zeros kept."""
    counts = diff.filter("field is not null").groupBy("category", *ENTRY).agg(F.count("*").alias("n")).groupBy("category").agg(
        F.sum("n").alias("changes"), F.count("*").alias("changed_entries"))
    dims = diff.sparkSession.createDataFrame([(d,) for d in DIMENSIONS], "category string")
    return dims.join(counts, "category", "left").na.fill(0)


def source_labels(batches: DataFrame) -> DataFrame:
    """(snapshot_id, kind, label): each distinct label of a snapshot as a row."""
    kinds = ("endpoint_class", "endpoint_label", "database_release")
    stacked = F.inline(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(kind).cast("string").alias("label")) for kind in kinds]))
    return batches.select("snapshot_id", stacked).filter("label IS NOT NULL").distinct()


def source_summary(entries: DataFrame, missing: DataFrame, batches: DataFrame) -> DataFrame:
    """Counts, times and labels of each snapshot (all inputs carry ``snapshot_id``).

    Labels of each kind are listed in order, with their number, the first and the last; as rows they are in :func:`source_labels`.
    An entry of several cards counts once.
    """
    facts = batches.groupBy("snapshot_id").agg(
        F.count("*").alias("batches"), F.count("database_release").alias("labelled_batches"),
        F.sum(F.when(F.col("origin") == "network", F.col("attempt_count")).otherwise(0)).alias("network_requests"),
        F.count_if(F.col("origin") == "cache").alias("cache_hits"),
        F.count_if("is_stale").alias("stale_batches"),
        F.min("retrieved_at").alias("first_retrieved"), F.max("retrieved_at").alias("last_retrieved"))
    labels = source_labels(batches).groupBy("snapshot_id").agg(*[
        made for kind, plural, number in (
            ("endpoint_class", "endpoint_classes", "endpoint_class_count"), ("endpoint_label", "endpoint_labels", "endpoint_label_count"),
            ("database_release", "releases", "release_count"))
        for mine in (F.when(F.col("kind") == kind, F.col("label")),)
        for made in (F.nullif(F.sort_array(F.collect_list(mine)), F.array().cast("array<string>")).alias(plural), F.count(mine).alias(number),
                     F.min(mine).alias(f"first_{kind}"), F.max(mine).alias(f"last_{kind}"))])
    entry_counts = entries.select("snapshot_id", *ENTRY).distinct().groupBy("snapshot_id").agg(F.count("*").alias("entries"))
    missing_counts = missing.groupBy("snapshot_id").agg(F.count("*").alias("missing_entries"))
    return facts.join(labels, "snapshot_id", "left").join(entry_counts, "snapshot_id", "left").join(missing_counts, "snapshot_id", "left").na.fill(
        0, ["entries", "missing_entries", "endpoint_class_count", "endpoint_label_count", "release_count"])


def release_status(batches: DataFrame) -> DataFrame:
    """same, different, mixed, partial or unavailable for the left and right snapshot."""
    side = lambda name: F.when(F.col("snapshot_id") == name, F.col("database_release"))
    unlabelled = lambda name: F.count_if((F.col("snapshot_id") == name) & F.col("database_release").isNull())
    facts = batches.agg(F.min(side("left")).alias("l"), F.max(side("left")).alias("l2"), F.min(side("right")).alias("r"),
                        F.max(side("right")).alias("r2"), unlabelled("left").alias("lm"), unlabelled("right").alias("rm"))
    none_l, none_r = F.col("l").isNull(), F.col("r").isNull()
    status = (
        F.when(none_l & none_r, F.lit("unavailable"))
        .when((F.col("lm") > 0) | (F.col("rm") > 0) | none_l | none_r, F.lit("partial"))
        .when((F.col("l") < F.col("l2")) | (F.col("r") < F.col("r2")), F.lit("mixed"))
        .when(F.col("l") == F.col("r"), F.lit("same")).otherwise(F.lit("different"))
    )
    return facts.select(status.alias("release_status"))


def context_compatible(batches: DataFrame) -> DataFrame:
    """Whether both snapshots have equal sets of endpoint and retrieval contexts."""
    def one_sided(*columns: str) -> DataFrame:
        """Number of distinct contexts that only one snapshot has."""
        held = batches.groupBy(*[F.col(c).cast("string").alias(c) for c in columns]).agg(
            F.bool_or(F.col("snapshot_id") == "left").alias("l"), F.bool_or(F.col("snapshot_id") == "right").alias("r"))
        return held.agg(F.count_if(F.coalesce("l", F.lit(False)) != F.coalesce("r", F.lit(False))).alias("n"))

    endpoint = one_sided("endpoint_class", "endpoint_label").select((F.col("n") == 0).alias("endpoint_compatible"), F.lit(1).alias("one"))
    retrieval = one_sided("origin", "cache_state", "is_stale").select((F.col("n") == 0).alias("retrieval_compatible"), F.lit(1).alias("one"))
    return endpoint.join(retrieval, "one").drop("one")  # one row each


def select_bundle(cards: DataFrame, selection: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Selected cards, and selected ids that the snapshot does not hold (must be empty)."""
    chosen = selection.select(*ENTRY).distinct()
    return cards.join(chosen, ENTRY, "left_semi"), chosen.join(cards.select(*ENTRY).distinct(), ENTRY, "left_anti")
