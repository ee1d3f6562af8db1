"""Identifier resolution: crosswalks, existing entries, projections and mapping status."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orthoflow.functions import identifiers as I


def convert_identifiers(inputs: DataFrame, crosswalk: DataFrame, source_db: str, target_db: str) -> DataFrame:
    """Left join against the crosswalk; a direction outside the allowed ones is an error.

    ``inputs`` has ``input_identifier`` and ``source_id`` (normalized for the source namespace).
    """
    genes, substances = I.GENE_NAMESPACES, I.SUBSTANCE_KINDS
    allowed = {("genes", n) for n in genes} | {(n, "genes") for n in genes} | {
        pair for kind in substances for n in I.SUBSTANCE_NAMESPACES for pair in ((kind, n), (n, kind))}
    if (source_db, target_db) not in allowed:
        raise ValueError(f"conversion {source_db} to {target_db} is not allowed")
    return inputs.join(crosswalk.select("source_id", F.col("target_id").alias("candidate_id")).distinct(), "source_id", "left")


def existing_entries(candidates: DataFrame, entries: DataFrame, on: str = "candidate_id") -> DataFrame:
    return candidates.join(entries.select(on).distinct(), on, "left_semi")


def organism_prefixes(genomes: DataFrame, organism: str) -> DataFrame:
    """The prefixes a gene of one organism may carry: its code and its T-number."""
    row = genomes.filter((F.col("code") == organism) | (F.col("t_number") == organism))
    return row.select(F.explode(F.array("code", "t_number")).alias("prefix")).distinct()


def organism_filter(candidates: DataFrame, prefixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept candidates, dropped count per input). The planner picks the join by the size of ``prefixes``."""
    prefixed = candidates.withColumn("prefix", F.substring_index("candidate_id", ":", 1))
    marked = prefixed.join(prefixes.withColumn("own", F.lit(True)), "prefix", "left")
    dropped = marked.filter("candidate_id is not null").groupBy("input_identifier").agg(
        F.count_if(F.col("own").isNull()).alias("dropped"))
    return marked.filter("own").drop("own", "prefix"), dropped


def entry_aliases(requests: DataFrame) -> DataFrame:
    """Alias keys under which a returned entry may answer a request (gene, genome, any other kind).

    A gene answers by its full id, or by its suffix together with its organism code; a genome by
    T-number or by organism code.
    """
    suffix = F.regexp_extract("identifier", r"^[^:]+:(.*)$", 1)
    prefix = F.substring_index("identifier", ":", 1)
    gene = F.array(F.concat(F.lit("id:"), F.col("identifier")), F.concat(F.lit("gene:"), suffix, F.lit("|"), prefix))
    genome = F.array(F.concat(F.lit("id:"), F.col("identifier")), F.concat(F.lit("code:"), F.col("identifier")))
    plain = F.array(F.concat(F.lit("id:"), F.col("identifier")))
    keys = F.when(F.col("kind") == "gene", gene).when(F.col("kind") == "genome", genome).otherwise(plain)
    return requests.select("*", F.explode(keys).alias("alias"))


def returned_aliases(entries: DataFrame) -> DataFrame:
    """Alias keys of returned entries (``identifier``, ``organism_code`` or NULL, ``kind``)."""
    keys = F.array_compact(F.array(
        F.concat(F.lit("id:"), F.col("identifier")),
        F.when(F.col("kind") == "gene", F.concat(F.lit("gene:"), F.col("identifier"), F.lit("|"), F.col("organism_code"))),
        F.when(F.col("kind") == "genome", F.concat(F.lit("code:"), F.col("organism_code")))))
    return entries.select(F.col("identifier").alias("returned_id"), "kind", F.explode(keys).alias("alias"))


def match_entries(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """Matches of each returned entry with a flag whether exactly one request fits.

    The alternative conditions become one equi-join on alias keys.
    """
    pairs = entry_aliases(requests).join(returned_aliases(entries), ["kind", "alias"]).select(
        "kind", "returned_id", F.col("identifier").alias("requested_id")).distinct()
    return pairs.groupBy("kind", "returned_id").agg(
        F.min("requested_id").alias("requested_id"), F.count("*").alias("matches")).withColumn("unique_match", F.col("matches") == 1)


def relation_edges(relations: DataFrame, relationship: str) -> DataFrame:
    source_kind, target_kind, _ = I.RELATION_TYPES[relationship]
    return relations.filter(F.col("relationship") == relationship).select(
        I.normalize_pair_entity(source_kind, F.col("source_id")).alias("source"),
        I.normalize_pair_entity(target_kind, F.col("target_id")).alias("target")).filter(
        "source is not null and target is not null").distinct()


def typed_edges(relations: DataFrame, relationships: list[str]) -> DataFrame:
    """(relationship, source, target) of several relationships in one scan, ids normalized, distinct."""
    def entity(side: int, column: str):
        return F.coalesce(*[F.when(F.col("relationship") == name, I.normalize_pair_entity(I.RELATION_TYPES[name][side], F.col(column))) for name in relationships])

    return relations.filter(F.col("relationship").isin(relationships)).select(
        "relationship", entity(0, "source_id").alias("source"), entity(1, "target_id").alias("target")).filter(
        "source is not null and target is not null").distinct()


def gene_relationships(targets: tuple[str, ...]) -> list[str]:
    """Relationships on the ways from a gene to the targets."""
    direct = [f"gene_to_{t}" for t in ("ko", "pathway") if t in targets]
    further = [f"ko_to_{t}" for t in targets if t not in ("gene", "ko", "pathway")]
    return list(dict.fromkeys([*direct, *(["gene_to_ko"] if further else []), *further]))


def genes_to_targets(candidates: DataFrame, relations: DataFrame, targets: tuple[str, ...], edges: DataFrame | None = None) -> DataFrame:
    """(candidate_id, target_kind, target_id): gene -> KO -> module, reaction, enzyme; gene -> pathway.

    Two joins for all targets: genes with what they lead to directly, and their KOs with the rest. ``edges`` may be a
    written table of ``typed_edges``; the relations are then not read.
    """
    genes = candidates.select(F.col("candidate_id").alias("gene")).filter("gene is not null").distinct()
    parts = []
    names = gene_relationships(targets)
    if names:
        edges = typed_edges(relations, names) if edges is None else edges
        kind = lambda prefix: F.substring_index("relationship", prefix, -1)
        first = genes.join(edges.filter(F.col("relationship").startswith("gene_to_")), F.col("gene") == F.col("source")).select(
            "gene", kind("gene_to_").alias("target_kind"), F.col("target").alias("target_id"))
        parts.append(first.filter(F.col("target_kind").isin(*targets)))
        if any(name.startswith("ko_to_") for name in names):
            kos = first.filter("target_kind = 'ko'").select("gene", F.col("target_id").alias("ko"))
            parts.append(kos.join(edges.filter(F.col("relationship").startswith("ko_to_")), F.col("ko") == F.col("source")).select(
                "gene", kind("ko_to_").alias("target_kind"), F.col("target").alias("target_id")).distinct())
    if "gene" in targets:
        parts.append(genes.select("gene", F.lit("gene").alias("target_kind"), F.col("gene").alias("target_id")))
    return reduce(DataFrame.unionByName, parts).withColumnRenamed("gene", "candidate_id")


def substances_to_targets(candidates: DataFrame, relations: DataFrame, kind: str, targets: tuple[str, ...]) -> DataFrame:
    """compound and glycan -> reaction, pathway; drug -> pathway."""
    ids = candidates.select("candidate_id").filter("candidate_id is not null").distinct()
    parts = [ids.select("candidate_id", F.lit(kind).alias("target_kind"), F.col("candidate_id").alias("target_id"))]
    for target in targets:
        relationship = f"{kind}_to_{target}"
        if relationship in I.RELATION_TYPES:
            edges = relation_edges(relations, relationship)
            parts.append(ids.join(edges, F.col("candidate_id") == F.col("source")).select(
                "candidate_id", F.lit(target).alias("target_kind"), F.col("target").alias("target_id")))
    return reduce(DataFrame.unionByName, parts)


def mapping_status(inputs: DataFrame, candidates: DataFrame, dropped: DataFrame | None = None) -> DataFrame:
    """Status of every input from two counts: candidates per input, inputs per candidate."""
    pairs = candidates.select("input_identifier", "candidate_id").filter("candidate_id is not null").distinct()
    shared = pairs.groupBy("candidate_id").agg(F.count("*").alias("inputs"))
    per_input = pairs.join(shared, "candidate_id").groupBy("input_identifier").agg(
        F.count("*").alias("candidates"), F.max("inputs").alias("most_inputs"))
    result = inputs.select("input_identifier").distinct().join(per_input, "input_identifier", "left")
    if dropped is not None:
        result = result.join(dropped, "input_identifier", "left")
    else:
        result = result.withColumn("dropped", F.lit(0).cast("bigint"))
    result = result.na.fill(0, ["candidates", "most_inputs", "dropped"])
    status = (
        F.when((F.col("candidates") == 0) & (F.col("dropped") > 0), F.lit("organism_mismatch"))
        .when(F.col("candidates") == 0, F.lit("unmapped"))
        .when(F.col("candidates") > 1, F.lit("one_to_many"))
        .when(F.col("most_inputs") > 1, F.lit("many_to_one"))
        .otherwise(F.lit("one_to_one"))
    )
    return result.select("input_identifier", status.alias("status"), "candidates", "dropped")


def resolution_summary(status: DataFrame, projections: DataFrame, candidates: DataFrame) -> DataFrame:
    """Totals of a resolution; entities are counted before and after deduplication."""
    mapped = F.col("status").isin("one_to_one", "one_to_many", "many_to_one")
    totals = status.agg(
        F.count("*").alias("inputs"), F.count_if(mapped).alias("mapped"),
        F.count_if(F.col("status") == "one_to_many").alias("ambiguous"),
        F.count_if(F.col("status") == "many_to_one").alias("many_to_one"),
        F.count_if(F.col("dropped") > 0).alias("mismatched"),
        F.try_divide(F.count_if(mapped), F.count("*")).alias("mapping_yield"))
    per_candidate = projections.groupBy("candidate_id").agg(F.count("*").alias("n"))
    uses = candidates.filter("candidate_id is not null").select("input_identifier", "candidate_id").distinct()
    before = uses.join(per_candidate, "candidate_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("entities_before"))
    after = projections.select("target_kind", "target_id").distinct().agg(F.count("*").alias("unique_entities"))
    one = F.lit(1).alias("one")
    return totals.select("*", one).join(before.select("*", one), "one").join(after.select("*", one), "one").drop("one")


def distinct_entities(entities: DataFrame, position: str) -> DataFrame:
    """First-seen unique entities with the position where they appear first."""
    return entities.groupBy("kind", "identifier").agg(F.min(position).alias(position))


def organism_identities(inputs: DataFrame, genomes: DataFrame, namespace: str) -> DataFrame:
    """code, T-number, taxonomy or name input -> genome, organism code and taxonomy identity."""
    column = {"code": "code", "genome": "t_number", "taxonomy": "taxonomy_id", "name": "name"}[namespace]
    known = genomes.select(F.col(column).alias("input_identifier"), "t_number", "code", "taxonomy_id")
    return inputs.join(known, "input_identifier", "left")


def identity_conflicts(identities: DataFrame) -> DataFrame:
    """T-numbers that answer to more than one organism code, an error for a strict caller."""
    return identities.filter("t_number is not null").groupBy("t_number").agg(
        F.min("code").alias("code"), F.max("code").alias("other_code")).filter("code <> other_code")


def taxonomy_rank_match(requests: DataFrame, taxonomy: DataFrame, genomes: DataFrame) -> DataFrame:
    """Genomes at or below a taxonomy id, for the exact id or an ancestor at a rank."""
    exact = requests.filter("rank = 'exact'").join(
        genomes.select(F.col("taxonomy_id").alias("requested_id"), "t_number"), "requested_id")
    below = requests.filter("rank <> 'exact'").join(
        taxonomy.select(F.col("ancestor").alias("requested_id"), "rank", "taxonomy_id"), ["requested_id", "rank"]).join(
        genomes.select("taxonomy_id", "t_number"), "taxonomy_id").select("requested_id", "rank", "t_number")
    return exact.select("requested_id", "rank", "t_number").unionByName(below).distinct()


def organism_pathway_summary(directory: DataFrame, preview: int) -> DataFrame:
    """Pathways per organism with the first few in directory order.

    Only the first ``preview`` rows of an organism are kept for the list; the count is separate.
    """
    first = directory.withColumn("no", F.row_number().over(W.partitionBy("organism").orderBy("line_no"))).filter(F.col("no") <= preview)
    shown = first.groupBy("organism").agg(F.transform(F.sort_array(F.collect_list(F.struct("no", "pathway_id"))), lambda r: r["pathway_id"]).alias("preview"))
    totals = directory.groupBy("organism").agg(F.count("*").alias("total"))
    return totals.join(shown, "organism").select("organism", "total", "preview", (F.col("total") > preview).alias("truncated"))
