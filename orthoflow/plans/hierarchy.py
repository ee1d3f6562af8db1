"""Entities to hierarchy paths, unmatched entities and prefix counts."""

from __future__ import annotations

from pyspark.sql import DataFrame

from orthoflow.operators import hierarchy as H


def map_entities(entities: DataFrame, lines: DataFrame, scope: DataFrame | None = None, all_paths: bool = True,
                 levels: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(paths, unmatched, counts). ``scope`` restricts each entity to discovered hierarchies."""
    paths = H.entity_paths(entities, H.hierarchy_paths(H.hierarchy_nodes(lines), levels), scope)
    if not all_paths:
        paths = H.first_paths(paths)
    return paths, H.unmatched_entities(entities, paths), H.prefix_counts(paths)
