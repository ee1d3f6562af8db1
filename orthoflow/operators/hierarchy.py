"""Hierarchy text: nodes, root-to-node paths, entity matches and prefix counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orthoflow.functions.staging import computed
from orthoflow.functions.text import strip
from orthoflow.session import cut_lineage

# Data lines, ids that look official.
DATA_LINE = r"^[A-Z]"
OFFICIAL_ID = r"^(?:[A-Z][0-9]{5}|[0-9]{5}|[1-7](?:\.(?:[0-9]+|-)){3})$"
CLASSIC_ROOT = r"^A(?:\s|[0-9<])"
COMPACT_ROOT = r"^A\S"
METADATA_HEADER = r"^\+[A-Z]\t"
PATH_CHUNK = 1 << 16


def hierarchy_nodes(lines: DataFrame) -> DataFrame:
    """Data lines with depth, official id (or NULL), name and the first token."""
    body = strip(F.substr(F.col("line"), F.lit(2)))
    data = lines.filter(F.col("line").rlike(DATA_LINE)).withColumn("body", body)
    token = F.regexp_extract(F.col("body"), r"^(\S+)", 1)
    official = token.rlike(OFFICIAL_ID)
    return data.select(
        "hierarchy_id", "line_no", (F.ascii("line") - 65).alias("depth"), F.substring("line", 1, 1).alias("level"),
        F.when(official, token).alias("node_id"),
        F.when(official, F.regexp_replace("body", r"^\S+\s*", "")).otherwise(F.col("body")).alias("name"),
        token.alias("candidate"),
    )


def document_roots(lines: DataFrame) -> DataFrame:
    """Whether a document has a root line: a classic one, or a compact one after the header block."""
    line = F.col("line")
    facts = lines.groupBy("hierarchy_id").agg(
        F.count("*").alias("lines"), F.bool_or(line.rlike(CLASSIC_ROOT)).alias("classic"),
        F.min(F.when(line.rlike(METADATA_HEADER), F.col("line_no"))).alias("header_line"),
        F.max(F.when(line == "!", F.col("line_no"))).alias("last_delimiter"),
        F.max(F.when(line.rlike(COMPACT_ROOT), F.col("line_no"))).alias("last_compact"))
    compact = F.coalesce((F.col("last_delimiter") > F.col("header_line")) & (F.col("last_compact") > F.col("last_delimiter")), F.lit(False))
    return facts.select("hierarchy_id", "lines", (F.col("classic") | compact).alias("has_root"))


def _chunked(nodes: DataFrame, chunk: int) -> DataFrame:
    return nodes.withColumn("chunk", F.floor(F.col("line_no") / chunk))


def level_gaps(nodes: DataFrame, chunk: int = PATH_CHUNK) -> DataFrame:
    """Nodes that are more than one level below the line before them (or do not start at A).

    The line before the first one of a chunk comes from a table with one row per chunk.
    """
    parts = _chunked(nodes, chunk)
    ends = parts.groupBy("hierarchy_id", "chunk").agg(F.max_by("depth", "line_no").alias("end_depth"))
    carried = ends.withColumn("carry", F.lag("end_depth").over(W.partitionBy("hierarchy_id").orderBy("chunk"))).drop("end_depth")
    inside = W.partitionBy("hierarchy_id", "chunk").orderBy("line_no")
    previous = F.coalesce(F.lag("depth").over(inside), F.col("carry"), F.lit(-1))
    return parts.join(carried, ["hierarchy_id", "chunk"]).withColumn("previous_depth", previous).filter(
        "depth > previous_depth + 1").drop("chunk", "carry")


def hierarchy_paths(nodes: DataFrame, levels: int | None = None, chunk: int = PATH_CHUNK) -> DataFrame:
    """Root-to-node path of every node, as array<struct<depth, level, node_id, name>>.

    The ancestor at a level is the last node of that level before the line. One document may be far
    larger than a task should hold, so each chunk of lines finds its own ancestors and takes the ones
    from earlier chunks out of a table with at most one row per chunk and level. Run ``level_gaps``
    first: paths assume that a level grows by at most one. Without ``levels`` the deepest node says how
    many there are (26 at most, one row to the driver). The nodes are written once (checkpoint), so the lines are read once.
    """
    nodes = cut_lineage(nodes)
    if levels is None:
        levels = (nodes.agg(F.max("depth").alias("d")).first()["d"] or 0) + 1
    node = F.struct("depth", "level", "node_id", "name")
    parts = _chunked(nodes, chunk).withColumn("node", node)
    lasts = parts.groupBy("hierarchy_id", "chunk", "depth").agg(F.max_by("node", "line_no").alias("last"))
    chunks = parts.select("hierarchy_id", "chunk").distinct()
    pivoted = lasts.groupBy("hierarchy_id", "chunk").agg(
        *[F.first(F.when(F.col("depth") == d, F.col("last")), ignorenulls=True).alias(f"last_{d}") for d in range(levels)])
    before = W.partitionBy("hierarchy_id").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    carried = chunks.join(pivoted, ["hierarchy_id", "chunk"]).select(
        "hierarchy_id", "chunk", *[F.last(f"last_{d}", ignorenulls=True).over(before).alias(f"carry_{d}") for d in range(levels)])
    inside = W.partitionBy("hierarchy_id", "chunk").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    ancestors = [
        F.coalesce(F.last(F.when(F.col("depth") == d, F.col("node")), ignorenulls=True).over(inside), F.col(f"carry_{d}")).alias(f"a_{d}")
        for d in range(levels)
    ]
    joined = parts.join(carried, ["hierarchy_id", "chunk"]).select("hierarchy_id", "line_no", "depth", "candidate", *ancestors)
    path = F.slice(F.array(*[F.col(f"a_{d}") for d in range(levels)]), F.lit(1), F.col("depth") + 1)
    return computed(joined, path=path).select("hierarchy_id", "line_no", "depth", "candidate", "path")


def entity_match_tokens(entities: DataFrame) -> DataFrame:
    """Tokens that identify an entity inside a hierarchy."""
    identifier = F.col("identifier")
    tokens = F.array_distinct(F.array_compact(F.array(
        identifier,
        F.when(F.col("kind").isin("pathway", "hierarchy"), F.right(identifier, F.lit(5))),
        F.when(F.col("kind") == "taxonomy", F.regexp_replace(identifier, "^taxid:", "")),
    )))
    return entities.select("*", F.explode(tokens).alias("candidate"))


def entity_paths(entities: DataFrame, paths: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """Every path of every entity; the last node takes the entity's id when it has none.

    ``scope`` limits an entity to its discovered hierarchies (kind, identifier, hierarchy_id).
    """
    matched = entity_match_tokens(entities).join(paths, "candidate")
    if scope is not None:
        matched = matched.join(scope, ["kind", "identifier", "hierarchy_id"], "left_semi")
    last = F.element_at("path", -1)
    named = last.withField("node_id", F.coalesce(last["node_id"], F.col("identifier")))
    path = F.concat(F.slice("path", F.lit(1), F.size("path") - 1), F.array(named))
    return computed(matched, path=path).groupBy("kind", "identifier", "hierarchy_id", "path").agg(F.min("line_no").alias("line_no"))


def first_paths(paths: DataFrame) -> DataFrame:
    """The first path of each (entity, hierarchy)."""
    return paths.groupBy("kind", "identifier", "hierarchy_id").agg(
        F.min("line_no").alias("line_no"), F.min_by("path", "line_no").alias("path"))


def unmatched_entities(entities: DataFrame, paths: DataFrame) -> DataFrame:
    return entities.select("kind", "identifier").join(paths.select("kind", "identifier").distinct(), ["kind", "identifier"], "left_anti")


def prefix_counts(paths: DataFrame) -> DataFrame:
    """Distinct entities under every path prefix.

    Prefixes near the root are shared by all entities; distinct (prefix, entity) pairs are reduced
    first and the final count combines map-side, so no entity list is ever held together.
    """
    prefixes = F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.slice("path", F.lit(1), n))
    pairs = paths.select("kind", "identifier", "hierarchy_id", F.explode(prefixes).alias("prefix")).distinct()
    return pairs.groupBy("hierarchy_id", "prefix").agg(F.count("*").alias("n"))


def discovered_scope(relations: DataFrame) -> DataFrame:
    """KO entities and the hierarchies their relation rows name."""
    from orthoflow.functions import identifiers as I

    return relations.filter("relationship = 'ko_to_hierarchy'").select(
        F.lit("ko").alias("kind"), I.normalize_ko(I.last_part(F.col("source_id"))).alias("identifier"),
        I.normalize_pair_entity("hierarchy", F.col("target_id")).alias("hierarchy_id"),
    ).filter("identifier is not null and hierarchy_id is not null").distinct()
