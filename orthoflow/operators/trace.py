"""Bounded relation traces over typed edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthoflow.functions import identifiers as I
from orthoflow.session import cut_lineage

NODE = ["kind", "identifier"]


def typed_edges(relations: DataFrame, edge_types: tuple[str, ...], organism: str | None = None) -> DataFrame:
    """Distinct typed edges with the sorted batch indexes of their repeated rows.

    Source and target kinds come from the relation type. With ``organism``, pathway-to-gene edges keep
    that organism's pathways only, and gene endpoints of another organism are left out.
    """
    unknown = set(edge_types) - set(I.RELATION_TYPES)
    if unknown:
        raise ValueError(f"unknown relation types: {sorted(unknown)}")
    if "pathway_to_gene" in edge_types and organism is None:
        raise ValueError("pathway_to_gene needs an organism scope")
    chosen = {name: I.RELATION_TYPES[name] for name in edge_types}

    def by_type(pick) -> Column:
        items = list(chosen.items())
        first = F.when(F.col("relationship") == items[0][0], pick(items[0][1]))
        return reduce(lambda acc, item: acc.when(F.col("relationship") == item[0], pick(item[1])), items[1:], first)

    typed = relations.filter(F.col("relationship").isin(*edge_types)).select(
        "relationship", "batch_index",
        by_type(lambda t: F.lit(t[0])).alias("source_kind"),
        by_type(lambda t: I.normalize_pair_entity(t[0], F.col("source_id"))).alias("source_identifier"),
        by_type(lambda t: F.lit(t[1])).alias("target_kind"),
        by_type(lambda t: I.normalize_pair_entity(t[1], F.col("target_id"))).alias("target_identifier"),
    ).filter("source_identifier is not null and target_identifier is not null")
    if organism is not None:
        pathway = F.regexp_extract("source_identifier", r"^(.+)[0-9]{5}$", 1)
        typed = typed.filter((F.col("relationship") != "pathway_to_gene") | (pathway == organism))
        for side in ("source", "target"):
            head = F.substring_index(f"{side}_identifier", ":", 1)
            typed = typed.filter((F.col(f"{side}_kind") != "gene") | (head == organism))
    return typed


def merge_edge_provenance(edges: DataFrame) -> DataFrame:
    """One row per edge with the union of its batch indexes (batches are requests, so few per edge)."""
    key = ["relationship", "source_kind", "source_identifier", "target_kind", "target_identifier"]
    return edges.groupBy(*key).agg(F.array_sort(F.collect_set("batch_index")).alias("batch_indexes"))


def trace(seeds: DataFrame, edges: DataFrame, max_depth: int) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges reached in up to ``max_depth`` levels, each with its first depth.

    Every level joins only the nodes first reached on the level before, so a node is expanded once
    and each edge has exactly one depth. The visited nodes are checkpointed per level: the lineage
    stays short and a lost executor costs one level. The edges are checkpointed once, placed by their
    source, so no level builds them again. Levels end early when nothing new is reached.
    """
    edges = cut_lineage(edges.repartition("source_kind", "source_identifier"))
    visited = seeds.select(*NODE).distinct().withColumn("depth", F.lit(0))
    frontier = visited
    found = []
    for depth in range(1, max_depth + 1):
        step = edges.join(
            frontier.select(F.col("kind").alias("source_kind"), F.col("identifier").alias("source_identifier")),
            ["source_kind", "source_identifier"], "left_semi").withColumn("depth", F.lit(depth))
        found.append(step)
        reached = step.select(F.col("target_kind").alias("kind"), F.col("target_identifier").alias("identifier")).distinct()
        frontier = cut_lineage(reached.join(visited, NODE, "left_anti").withColumn("depth", F.lit(depth)))
        visited = visited.unionByName(frontier)
        if frontier.isEmpty():
            break
    return visited, reduce(DataFrame.unionByName, found)


def genome_to_taxonomy(genomes: DataFrame, relations: DataFrame) -> DataFrame:
    """genome (T-number) -> taxonomy edges: the relation names the genome by its organism code.

    The genomes say which codes exist, also where a code is spelled like a reserved prefix (``pmid``).
    """
    links = relations.filter("relationship = 'genome_to_taxonomy'").select(
        F.regexp_replace("source_id", "^(?:organism|gn|genome):", "").alias("code"),
        I.normalize_pair_entity("taxonomy", F.col("target_id")).alias("taxonomy_id"), "batch_index")
    return genomes.select("t_number", "code").join(links, "code").select("t_number", "taxonomy_id", "batch_index")


def taxonomy_to_genome(taxonomies: DataFrame, genomes: DataFrame, relations: DataFrame) -> DataFrame:
    """taxonomy -> genome edges: the relation may name a genome by code or by T-number."""
    aliases = genomes.select("t_number", F.explode(F.array("t_number", "code")).alias("alias"))
    links = relations.filter("relationship = 'taxonomy_to_genome'").select(
        I.normalize_pair_entity("taxonomy", F.col("source_id")).alias("taxonomy_id"),
        F.regexp_replace("target_id", "^(?:gn|genome):", "").alias("alias"), "batch_index")
    return taxonomies.join(links, "taxonomy_id").join(aliases, "alias").select("taxonomy_id", "t_number", "batch_index")
