"""Gene inputs to candidates, status and projected targets."""

from __future__ import annotations

from pyspark.sql import DataFrame

from orthoflow.operators import resolve as Z
from orthoflow.session import cut_lineage


def resolve_genes(inputs: DataFrame, crosswalk: DataFrame, namespace: str, prefixes: DataFrame, relations: DataFrame,
                  targets: tuple[str, ...]) -> DataFrame:
    """One row per input, candidate and target; inputs without candidates keep one row with NULLs.

    The converted inputs and the relations on the way are written once (checkpoints), so each table is read once.
    """
    found = cut_lineage(Z.convert_identifiers(inputs, crosswalk, namespace, "genes"))
    edges = cut_lineage(Z.typed_edges(relations, Z.gene_relationships(targets)))
    kept, dropped = Z.organism_filter(found, prefixes)
    status = Z.mapping_status(found, kept, dropped)
    rows = kept.select("input_identifier", "candidate_id").distinct().join(
        Z.genes_to_targets(kept, relations, targets, edges), "candidate_id", "left")
    return status.join(rows, "input_identifier", "left").select(
        "input_identifier", "status", "candidate_id", "target_kind", "target_id")
