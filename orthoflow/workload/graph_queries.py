"""Hierarchies, traces, resolution, search and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from orthoflow.functions import identifiers as I
from orthoflow.operators import hierarchy as H
from orthoflow.operators import resolve as Z
from orthoflow.operators import search as Q
from orthoflow.operators import snapshots as D
from orthoflow.operators import trace as T
from orthoflow.workload.registry import query
from orthoflow.workload.views import Inputs, digits, union, work_folder

EDGE_TYPES = ("compound_to_reaction", "reaction_to_pathway", "pathway_to_module", "module_to_reaction")


def joined(name: str, separator: str = ";"):
    return F.array_join(F.col(name).cast("array<string>"), separator).alias(name)


def path_text(column: str = "path"):
    """``name|id`` of every node from the root."""
    return F.array_join(F.transform(column, lambda n: F.concat(n["name"], F.lit("|"), F.coalesce(n["node_id"], F.lit("")))), " > ")


# --- hierarchies -------------------------------------------------------------------------------

_C = f"'C' || {digits('c_custkey')}"
_A = f"r_name || '|' || {digits('r_regionkey + 9100')}"
_TREE = f"""
SELECT c_custkey, n_nationkey, n_regionkey, {_C} AS customer_id, c_name, n_name, r_name, {_A} AS a_path, {_A} || ' > ' || n_name || '|' AS b_path,
  {_A} || ' > ' || n_name || '|' || ' > ' || c_name || '|' || {_C} AS c_path
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
_LOCAL = {"v_tree": _TREE}


def paths_of(data: Inputs):
    return H.hierarchy_paths(H.hierarchy_nodes(data.view("v_hierarchy_lines")))


def entity_paths_of(data: Inputs):
    return H.entity_paths(data.view("v_entities"), paths_of(data))


@query("scan_hierarchy_text", "SELECT hierarchy_id, count(*) AS lines, true AS has_root FROM v_hierarchy_lines GROUP BY 1")
def scan_hierarchy_text(spark, sf):
    return H.document_roots(Inputs(spark, sf).view("v_hierarchy_lines"))


@query("hierarchy_node", f"""
SELECT line_no, CASE substr(line, 1, 1) WHEN 'A' THEN 0 WHEN 'B' THEN 1 ELSE 2 END AS depth, nullif(regexp_extract(trim(substr(line, 2)), '^([A-Z]?[0-9]{{5}})( |$)', 1), '') AS node_id,
  CASE WHEN line LIKE 'B%' THEN trim(substr(line, 2)) ELSE regexp_replace(trim(substr(line, 2)), '^[A-Z]?[0-9]{{5}} ', '') END AS name FROM v_hierarchy_lines""")
def hierarchy_node(spark, sf):
    return H.hierarchy_nodes(Inputs(spark, sf).view("v_hierarchy_lines")).select("line_no", "depth", "node_id", "name")


@query("hierarchy_level_gaps", """
SELECT count(*) AS gaps FROM (SELECT d, coalesce(lag(d) OVER (ORDER BY line_no), -1) AS p FROM (SELECT line_no, CASE substr(line, 1, 1) WHEN 'A' THEN 0 WHEN 'B' THEN 1 ELSE 2 END AS d FROM v_hierarchy_lines) AS x) AS t WHERE d > p + 1""")
def hierarchy_level_gaps(spark, sf):
    return H.level_gaps(H.hierarchy_nodes(Inputs(spark, sf).view("v_hierarchy_lines"))).agg(F.count("*").alias("gaps"))


@query("hierarchy_paths", f"""
SELECT 2 AS depth, c_path AS path FROM v_tree UNION ALL SELECT 1, {_A} || ' > ' || n_name || '|' FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 0, {_A} FROM region""", _LOCAL)
def hierarchy_paths(spark, sf):
    return paths_of(Inputs(spark, sf)).select("depth", path_text().alias("path"))


@query("entity_match_tokens", f"""
SELECT kind, identifier, identifier AS candidate FROM v_mixed UNION ALL SELECT kind, identifier, right(identifier, 5) FROM v_mixed WHERE kind = 'pathway' UNION ALL SELECT kind, identifier, substr(identifier, 7) FROM v_mixed WHERE kind = 'taxonomy'""",
       {"v_mixed": f"SELECT * FROM v_entities UNION ALL SELECT 'pathway', pathway_id FROM v_pathways UNION ALL SELECT 'taxonomy', taxonomy_id FROM v_genomes"})
def entity_match_tokens(spark, sf):
    data = Inputs(spark, sf)
    mixed = union(data.view("v_entities"), data.view("v_pathways").select(F.lit("pathway").alias("kind"), F.col("pathway_id").alias("identifier")),
                  data.view("v_genomes").select(F.lit("taxonomy").alias("kind"), F.col("taxonomy_id").alias("identifier")))
    return H.entity_match_tokens(mixed).select("kind", "identifier", "candidate")


_MATCHED = "SELECT e.kind, e.identifier, t.* FROM v_entities e JOIN v_tree t ON e.identifier = t.customer_id"
_HIER = {**_LOCAL, "v_matched": _MATCHED}


@query("entity_in_hierarchy", "SELECT kind, identifier, c_path AS path FROM v_matched", _HIER)
def entity_in_hierarchy(spark, sf):
    return entity_paths_of(Inputs(spark, sf)).select("kind", "identifier", path_text().alias("path"))


@query("first_path_only", """
SELECT kind, identifier, c_path AS path FROM v_matched QUALIFY row_number() OVER (PARTITION BY kind, identifier ORDER BY n_regionkey, n_nationkey, c_custkey) = 1""", _HIER)
def first_path_only(spark, sf):
    return H.first_paths(entity_paths_of(Inputs(spark, sf))).select("kind", "identifier", path_text().alias("path"))


@query("unmatched_entities", "SELECT kind, identifier FROM v_entities WHERE identifier NOT IN (SELECT customer_id FROM v_tree)", _HIER)
def unmatched_entities(spark, sf):
    data = Inputs(spark, sf)
    return H.unmatched_entities(data.view("v_entities"), entity_paths_of(data))


_PREFIXES = """SELECT a_path AS prefix, count(DISTINCT identifier) AS n FROM v_matched GROUP BY 1 UNION ALL SELECT b_path, count(DISTINCT identifier) FROM v_matched GROUP BY 1
UNION ALL SELECT c_path, count(DISTINCT identifier) FROM v_matched GROUP BY 1"""


@query("hierarchy_prefix_counts", _PREFIXES, _HIER)
def hierarchy_prefix_counts(spark, sf):
    return H.prefix_counts(entity_paths_of(Inputs(spark, sf))).select(path_text("prefix").alias("prefix"), "n")


_MAP = f"""
SELECT 'path' AS section, kind || ':' || identifier AS item, c_path AS value FROM v_matched
UNION ALL SELECT 'unmatched', kind || ':' || identifier, '' FROM v_entities WHERE identifier NOT IN (SELECT customer_id FROM v_tree)
UNION ALL SELECT 'prefix', prefix, CAST(n AS VARCHAR) FROM v_prefixes"""


@query("map_hierarchy", _MAP, {**_HIER, "v_prefixes": _PREFIXES})
def map_hierarchy(spark, sf):
    from orthoflow.plans.hierarchy import map_entities

    data = Inputs(spark, sf)
    paths, unmatched, counts = map_entities(data.view("v_entities"), data.view("v_hierarchy_lines"))
    item = F.concat_ws(":", "kind", "identifier").alias("item")
    return union(paths.select(F.lit("path").alias("section"), item, path_text().alias("value")),
                 unmatched.select(F.lit("unmatched").alias("section"), item, F.lit("").alias("value")),
                 counts.select(F.lit("prefix").alias("section"), path_text("prefix").alias("item"), F.col("n").cast("string").alias("value")))


@query("write_hierarchy_paths", """
SELECT record_type, input_kind, input_identifier, depth, node_name, unique_input_count FROM (
 SELECT 'path_node' AS record_type, kind AS input_kind, identifier AS input_identifier, '0' AS depth, r_name AS node_name, CAST(count(*) OVER (PARTITION BY r_name) AS VARCHAR) AS unique_input_count FROM v_matched
 UNION ALL SELECT 'path_node', kind, identifier, '1', n_name, CAST(count(*) OVER (PARTITION BY n_name) AS VARCHAR) FROM v_matched UNION ALL SELECT 'path_node', kind, identifier, '2', c_name, '1' FROM v_matched
 UNION ALL SELECT 'unmatched', kind, identifier, '', '', '' FROM v_entities WHERE identifier NOT IN (SELECT customer_id FROM v_tree)) AS t""", _HIER)
def write_hierarchy_paths(spark, sf):
    from orthoflow.sinks.tables import hierarchy_path_table

    data = Inputs(spark, sf)
    paths = entity_paths_of(data)
    table = hierarchy_path_table(paths, H.prefix_counts(paths), H.unmatched_entities(data.view("v_entities"), paths))
    return table.select("record_type", "input_kind", "input_identifier", "depth", "node_name", "unique_input_count")


# --- traces ------------------------------------------------------------------------------------

_TYPED = """
SELECT relationship, CASE relationship WHEN 'compound_to_reaction' THEN 'compound' WHEN 'reaction_to_pathway' THEN 'reaction' WHEN 'pathway_to_module' THEN 'pathway' ELSE 'module' END AS source_kind, split_part(source_id, ':', 2) AS source,
  CASE relationship WHEN 'compound_to_reaction' THEN 'reaction' WHEN 'reaction_to_pathway' THEN 'pathway' WHEN 'pathway_to_module' THEN 'module' ELSE 'reaction' END AS target_kind, split_part(target_id, ':', 2) AS target,
  string_agg(DISTINCT CAST(batch_index AS VARCHAR), ';' ORDER BY CAST(batch_index AS VARCHAR)) AS batch_indexes FROM v_edges GROUP BY ALL"""
_REACHED = """WITH RECURSIVE reached(kind, identifier, depth) AS (SELECT kind, identifier, 0 FROM v_seeds UNION SELECT t.target_kind, t.target, r.depth + 1 FROM reached r JOIN v_typed t ON t.source_kind = r.kind AND t.source = r.identifier WHERE r.depth < {depth}),
first AS (SELECT kind, identifier, min(depth) AS depth FROM reached GROUP BY 1, 2)"""


def trace_of(data: Inputs, depth: int):
    edges = T.merge_edge_provenance(T.typed_edges(data.view("v_edges"), EDGE_TYPES))
    return T.trace(data.view("v_seeds"), edges, depth)


@query("trace_relations", _REACHED.format(depth=4) + """
SELECT t.relationship, t.source, t.target, f.depth + 1 AS depth, t.batch_indexes FROM v_typed t JOIN first f ON f.kind = t.source_kind AND f.identifier = t.source WHERE f.depth < 4""", {"v_typed": _TYPED})
def trace_relations(spark, sf):
    indexes = F.array_join(F.array_sort(F.col("batch_indexes").cast("array<string>")), ";").alias("batch_indexes")
    return trace_of(Inputs(spark, sf), 4)[1].select(
        "relationship", F.col("source_identifier").alias("source"), F.col("target_identifier").alias("target"), "depth", indexes)


@query("edge_first_depth", _REACHED.format(depth=2) + "SELECT kind, identifier, depth FROM first", {"v_typed": _TYPED})
def edge_first_depth(spark, sf):
    return trace_of(Inputs(spark, sf), 2)[0].select("kind", "identifier", "depth")


@query("merge_edge_provenance", "SELECT relationship, source, target, batch_indexes FROM v_typed", {"v_typed": _TYPED})
def merge_edge_provenance(spark, sf):
    edges = T.merge_edge_provenance(T.typed_edges(Inputs(spark, sf).view("v_edges"), EDGE_TYPES))
    indexes = F.array_join(F.array_sort(F.col("batch_indexes").cast("array<string>")), ";").alias("batch_indexes")
    return edges.select("relationship", F.col("source_identifier").alias("source"), F.col("target_identifier").alias("target"), indexes)


def genome_relations(data: Inputs):
    genomes = data.view("v_genomes")
    forward = genomes.selectExpr("'genome_to_taxonomy' as relationship", "'gn:' || code as source_id", "taxonomy_id as target_id", "0L as batch_index")
    alias = "case when region_name = 'ASIA' then 'genome:' || t_number else 'gn:' || code end"
    back = genomes.selectExpr("'taxonomy_to_genome' as relationship", "taxonomy_id as source_id", f"{alias} as target_id", "1L as batch_index")
    return forward.unionByName(back)


@query("trace_genome_taxonomy", """
SELECT 'forward' AS direction, t_number, taxonomy_id, 0 AS batch_index FROM v_genomes UNION ALL SELECT 'back', t_number, taxonomy_id, 1 FROM v_genomes""")
def trace_genome_taxonomy(spark, sf):
    data = Inputs(spark, sf)
    genomes, relations = data.view("v_genomes"), genome_relations(data)
    wanted = genomes.select("taxonomy_id").distinct()
    both = T.genome_to_taxonomy(genomes, relations).withColumn("direction", F.lit("forward")).unionByName(
        T.taxonomy_to_genome(wanted, genomes, relations).withColumn("direction", F.lit("back")))
    return both.select("direction", "t_number", "taxonomy_id", F.col("batch_index").cast("int").alias("batch_index"))


# --- resolution --------------------------------------------------------------------------------

_IDS = """SELECT * FROM (SELECT 'ko' AS kind, ko_id AS identifier FROM v_assign WHERE ko_id IS NOT NULL) AS t"""


@query("valid_identifier", """
SELECT c_custkey, kind, identifier, CASE c_custkey % 12 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN true WHEN 4 THEN false WHEN 5 THEN true WHEN 6 THEN true WHEN 7 THEN false WHEN 8 THEN true WHEN 9 THEN false WHEN 10 THEN true ELSE false END AS valid FROM v_ids""",
       {"v_ids": (IDS_SQL := """
SELECT c_custkey, CASE c_custkey % 12 WHEN 0 THEN 'ko' WHEN 1 THEN 'ko' WHEN 2 THEN 'gene' WHEN 3 THEN 'pathway' WHEN 4 THEN 'pathway' WHEN 5 THEN 'enzyme' WHEN 6 THEN 'enzyme' WHEN 7 THEN 'enzyme' WHEN 8 THEN 'taxonomy' WHEN 9 THEN 'organism' WHEN 10 THEN 'module' ELSE 'genome' END AS kind,
  CASE c_custkey % 12 WHEN 0 THEN 'K' || lpad(CAST(c_custkey % 100000 AS STRING), 5, '0') WHEN 1 THEN 'k00001' WHEN 2 THEN 'hsa:' || CAST(c_custkey AS STRING) WHEN 3 THEN 'hsa' || lpad(CAST(c_custkey % 100000 AS STRING), 5, '0') WHEN 4 THEN 'path00010'
   WHEN 5 THEN '1.1.1.' || CAST(c_nationkey AS STRING) WHEN 6 THEN '2.1.-.-' WHEN 7 THEN '1.-.1.1' WHEN 8 THEN 'taxid:' || CAST(c_custkey + 1 AS STRING) WHEN 9 THEN 'drug' WHEN 10 THEN 'eco_M00001' ELSE 'T1234' END AS identifier FROM customer""")})
def valid_identifier(spark, sf):
    data = Inputs(spark, sf)
    ids = spark.sql(IDS_SQL.replace("FROM customer", "FROM {customer}"), customer=data.table("customer"))
    return ids.withColumn("valid", I.valid_identifier(F.col("kind"), F.col("identifier")))


@query("normalize_pair_entity", """
SELECT relationship, target_id, CASE WHEN relationship = 'genome_to_taxonomy' THEN target_id ELSE split_part(target_id, ':', -1) END AS normalized, count(*) AS n FROM v_relations WHERE relationship <> 'none' GROUP BY ALL""")
def normalize_pair_entity(spark, sf):
    relations = Inputs(spark, sf).view("v_relations")
    kind = F.regexp_extract("relationship", r"_to_(.*)$", 1)
    return relations.groupBy("relationship", "target_id", I.normalize_pair_entity(kind, F.col("target_id")).alias("normalized")).agg(F.count("*").alias("n"))


@query("normalize_external_id", """
SELECT o_orderkey, raw, CASE o_orderkey % 6 WHEN 0 THEN 'chebi:' || n WHEN 1 THEN 'chebi:' || n WHEN 2 THEN 'pubchem:' || n WHEN 3 THEN NULL WHEN 4 THEN 'uniprot:P' || n ELSE 'ncbi-geneid:' || n END AS normalized FROM v_ext""",
       {"v_ext": (EXT_SQL := """SELECT o_orderkey, CAST(o_orderkey + 1 AS STRING) AS n, CASE o_orderkey % 6 WHEN 0 THEN 'CHEBI:' WHEN 1 THEN '' WHEN 2 THEN 'sid:' WHEN 3 THEN 'pubchem:0' WHEN 4 THEN 'P' ELSE '' END || CAST(o_orderkey + 1 AS STRING) AS raw,
  CASE o_orderkey % 6 WHEN 0 THEN 'chebi' WHEN 1 THEN 'chebi' WHEN 2 THEN 'pubchem' WHEN 3 THEN 'pubchem' WHEN 4 THEN 'uniprot' ELSE 'ncbi-geneid' END AS namespace FROM orders""")})
def normalize_external_id(spark, sf):
    ids = spark.sql(EXT_SQL.replace("FROM orders", "FROM {orders}"), orders=Inputs(spark, sf).table("orders"))
    return ids.select("o_orderkey", "raw", I.normalize_external_id(F.col("namespace"), F.col("raw")).alias("normalized"))


@query("validate_pair_target", """
SELECT source_id, target_id, regexp_full_match(target_id, 'ko:K[0-9]{5}') AS valid, count(*) AS n FROM v_pathway_link GROUP BY ALL""")
def validate_pair_target(spark, sf):
    links = Inputs(spark, sf).view("v_pathway_link")
    return links.groupBy("source_id", "target_id", I.pair_target_matches(F.lit("ko"), F.col("target_id")).alias("valid")).agg(F.count("*").alias("n"))


_INPUTS = "SELECT position, input_identifier, 'ncbi-geneid:' || input_identifier AS source_id FROM v_gene_inputs"
_CAND = "SELECT i.input_identifier, target_id AS candidate_id FROM v_in i LEFT JOIN v_crosswalk USING (source_id)"
_GENE = {"v_in": _INPUTS, "v_cand": _CAND}


def gene_inputs(data: Inputs):
    raw = data.view("v_gene_inputs")
    return raw.withColumn("source_id", I.normalize_external_id(F.lit("ncbi-geneid"), F.col("input_identifier")))


def gene_candidates(data: Inputs):
    return Z.convert_identifiers(gene_inputs(data), data.view("v_crosswalk"), "ncbi-geneid", "genes")


@query("convert_identifiers", "SELECT input_identifier, candidate_id FROM v_cand", _GENE)
def convert_identifiers(spark, sf):
    return gene_candidates(Inputs(spark, sf)).select("input_identifier", "candidate_id")


@query("existing_entries", """
SELECT input_identifier, candidate_id FROM v_cand WHERE candidate_id IN (SELECT source_id FROM v_gene_relations WHERE relationship = 'gene_to_ko' AND line_number IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0))""", _GENE)
def existing_entries(spark, sf):
    data = Inputs(spark, sf)
    known = data.view("v_gene_relations").filter("relationship = 'gene_to_ko'").join(
        data.table("supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("line_number")), "line_number").select(F.col("source_id").alias("candidate_id"))
    return Z.existing_entries(gene_candidates(data), known).select("input_identifier", "candidate_id")


def hsa(spark):
    return spark.range(1).select(F.explode(F.array(F.lit("hsa"), F.lit("T01001"))).alias("prefix"))


@query("organism_filter", """
SELECT input_identifier, count(candidate_id) FILTER (WHERE candidate_id LIKE 'hsa:%') AS kept, count(candidate_id) FILTER (WHERE candidate_id NOT LIKE 'hsa:%') AS dropped FROM v_cand WHERE candidate_id IS NOT NULL GROUP BY 1""", _GENE)
def organism_filter(spark, sf):
    kept, dropped = Z.organism_filter(gene_candidates(Inputs(spark, sf)), hsa(spark))
    return dropped.join(kept.groupBy("input_identifier").agg(F.count("*").alias("kept")), "input_identifier", "left").na.fill(0, ["kept"])


_STATUS = """
SELECT input_identifier, CASE WHEN c = 0 AND d > 0 THEN 'organism_mismatch' WHEN c = 0 THEN 'unmapped' WHEN c > 1 THEN 'one_to_many' WHEN shared > 1 THEN 'many_to_one' ELSE 'one_to_one' END AS status, c AS candidates, d AS dropped FROM (
 SELECT i.input_identifier, count(*) FILTER (WHERE candidate_id LIKE 'hsa:%') AS c, count(*) FILTER (WHERE candidate_id NOT LIKE 'hsa:%') AS d,
  max(CASE WHEN candidate_id LIKE 'hsa:%' THEN (SELECT count(DISTINCT x.input_identifier) FROM v_cand x WHERE x.candidate_id = i.candidate_id) END) AS shared FROM v_cand i GROUP BY 1) AS t"""
_GSTAT = {**_GENE, "v_status": _STATUS}


def resolved_genes(data: Inputs, spark):
    kept, dropped = Z.organism_filter(gene_candidates(data), hsa(spark))
    return kept, Z.mapping_status(gene_inputs(data), kept, dropped)


@query("mapping_status", "SELECT * FROM v_status", _GSTAT)
def mapping_status(spark, sf):
    return resolved_genes(Inputs(spark, sf), spark)[1]


_PROJ = """
SELECT DISTINCT candidate_id, target_kind, target_id FROM (
 SELECT g.candidate_id, 'ko' AS target_kind, split_part(k.target_id, ':', 2) AS target_id FROM v_genes g JOIN v_gene_relations k ON k.source_id = g.candidate_id AND k.relationship = 'gene_to_ko'
 UNION ALL SELECT g.candidate_id, 'pathway', split_part(k.target_id, ':', 2) FROM v_genes g JOIN v_gene_relations k ON k.source_id = g.candidate_id AND k.relationship = 'gene_to_pathway'
 UNION ALL SELECT g.candidate_id, 'module', split_part(r.target_id, ':', 2) FROM v_genes g JOIN v_gene_relations k ON k.source_id = g.candidate_id AND k.relationship = 'gene_to_ko' JOIN v_relations r ON r.source_id = k.target_id AND r.relationship = 'ko_to_module'
 UNION ALL SELECT candidate_id, 'gene', candidate_id FROM v_genes) AS p"""
_GPROJ = {**_GSTAT, "v_genes": "SELECT DISTINCT candidate_id FROM v_cand WHERE candidate_id LIKE 'hsa:%'", "v_proj": _PROJ}
TARGETS = ("gene", "ko", "module", "pathway")


def all_relations(data: Inputs):
    return data.view("v_relations").unionByName(data.view("v_gene_relations"))


@query("genes_to_targets", "SELECT * FROM v_proj", _GPROJ)
def genes_to_targets(spark, sf):
    data = Inputs(spark, sf)
    return Z.genes_to_targets(resolved_genes(data, spark)[0], all_relations(data), TARGETS)


@query("resolve_genes", """
SELECT c.input_identifier, s.status, c.candidate_id, p.target_kind, p.target_id FROM v_cand c JOIN v_status s USING (input_identifier) JOIN v_proj p USING (candidate_id)
UNION ALL SELECT input_identifier, status, NULL, NULL, NULL FROM v_status WHERE candidates = 0""", _GPROJ)
def resolve_genes(spark, sf):
    from orthoflow.plans.resolve import resolve_genes as plan

    data = Inputs(spark, sf)
    return plan(gene_inputs(data), data.view("v_crosswalk"), "ncbi-geneid", hsa(spark), all_relations(data), TARGETS)


@query("resolution_summary", """
SELECT count(*) AS inputs, count(*) FILTER (WHERE candidates > 0) AS mapped, count(*) FILTER (WHERE status = 'one_to_many') AS ambiguous, count(*) FILTER (WHERE status = 'many_to_one') AS many_to_one,
  count(*) FILTER (WHERE dropped > 0) AS mismatched, count(*) FILTER (WHERE candidates > 0) / count(*) AS mapping_yield,
  (SELECT count(*) FROM v_cand JOIN v_proj USING (candidate_id)) AS entities_before, (SELECT count(DISTINCT (target_kind, target_id)) FROM v_proj) AS unique_entities FROM v_status""", _GPROJ)
def resolution_summary(spark, sf):
    data = Inputs(spark, sf)
    kept, status = resolved_genes(data, spark)
    return Z.resolution_summary(status, Z.genes_to_targets(kept, all_relations(data), TARGETS), kept)


@query("distinct_entities", "SELECT CASE WHEN o_orderstatus = 'P' THEN 'glycan' ELSE 'compound' END AS kind, o_custkey % 1000 AS identifier, min(o_orderkey) AS position FROM orders GROUP BY 1, 2")
def distinct_entities(spark, sf):
    orders = Inputs(spark, sf).table("orders").selectExpr("case when o_orderstatus = 'P' then 'glycan' else 'compound' end as kind", "o_custkey % 1000 as identifier", "o_orderkey as position")
    return Z.distinct_entities(orders, "position")


@query("substances_to_targets", """
SELECT DISTINCT candidate_id, target_kind, target_id FROM (SELECT split_part(target_id, ':', 2) AS candidate_id, 'compound' AS target_kind, split_part(target_id, ':', 2) AS target_id FROM v_substance_crosswalk
 UNION ALL SELECT split_part(x.target_id, ':', 2), 'reaction', split_part(e.target_id, ':', 2) FROM v_substance_crosswalk x JOIN v_edges e ON e.source_id = x.target_id) AS t""")
def substances_to_targets(spark, sf):
    data = Inputs(spark, sf)
    candidates = data.view("v_substance_crosswalk").select(I.normalize_pair_entity("compound", F.col("target_id")).alias("candidate_id"))
    return Z.substances_to_targets(candidates, data.view("v_edges"), "compound", ("reaction", "pathway"))


@query("resolve_substances", """
SELECT i AS input_identifier, target_kind, target_id FROM (
 SELECT DISTINCT 'CHEBI:' || n AS i, split_part(x.target_id, ':', 2) AS c FROM (SELECT DISTINCT CAST(o_orderkey % 700 + 1 AS VARCHAR) AS n FROM orders) o JOIN v_substance_crosswalk x ON x.source_id = 'chebi:' || n) AS s
JOIN (SELECT DISTINCT split_part(target_id, ':', 2) AS c, 'compound' AS target_kind, split_part(target_id, ':', 2) AS target_id FROM v_substance_crosswalk
  UNION SELECT split_part(source_id, ':', 2), 'reaction', split_part(target_id, ':', 2) FROM v_edges WHERE relationship = 'compound_to_reaction') p USING (c)""")
def resolve_substances(spark, sf):
    data = Inputs(spark, sf)
    inputs = data.table("orders").selectExpr("'CHEBI:' || cast(o_orderkey % 700 + 1 as string) as input_identifier").distinct().withColumn(
        "source_id", I.normalize_external_id(F.lit("chebi"), F.col("input_identifier")))
    raw = Z.convert_identifiers(inputs, data.view("v_substance_crosswalk"), "chebi", "compound")
    candidates = raw.withColumn("candidate_id", I.normalize_pair_entity("compound", F.col("candidate_id")))
    projections = Z.substances_to_targets(candidates, data.view("v_edges"), "compound", ("reaction", "pathway"))
    return candidates.join(projections, "candidate_id").select("input_identifier", "target_kind", "target_id")


@query("organism_identities", """
SELECT o_orderkey, code AS input_identifier, t_number, taxonomy_id FROM (SELECT o_orderkey, chr(97 + CAST(k % 26 AS INT)) || chr(97 + CAST(floor(k / 26.0) AS INT) % 26) || chr(97 + CAST(floor(k / 676.0) AS INT) % 26) || chr(97 + CAST(floor(k / 17576.0) AS INT) % 26) AS code
 FROM (SELECT o_orderkey, o_custkey * 2 AS k FROM orders) AS x) AS y LEFT JOIN v_genomes g USING (code)""")
def organism_identities(spark, sf):
    from orthoflow.workload.views import letters

    data = Inputs(spark, sf)
    inputs = data.table("orders").selectExpr("o_orderkey", f"{letters('o_custkey * 2')} as input_identifier")
    return Z.organism_identities(inputs, data.view("v_genomes"), "code").select("o_orderkey", "input_identifier", "t_number", "taxonomy_id")


@query("taxonomy_rank_match", """
SELECT ancestor AS requested_id, rank, g.t_number FROM v_taxonomy t JOIN v_genomes g USING (taxonomy_id)
UNION SELECT taxonomy_id, 'exact', t_number FROM v_genomes""")
def taxonomy_rank_match(spark, sf):
    data = Inputs(spark, sf)
    taxonomy, genomes = data.view("v_taxonomy"), data.view("v_genomes")
    requests = taxonomy.select(F.col("ancestor").alias("requested_id"), "rank").unionByName(
        genomes.select(F.col("taxonomy_id").alias("requested_id"), F.lit("exact").alias("rank"))).distinct()
    return Z.taxonomy_rank_match(requests, taxonomy, genomes)


_DIRECTORY = "SELECT 'o' || chr(97 + CAST(s_nationkey AS INT)) || 'x' AS organism, s_suppkey AS line_no, 'path:o' || chr(97 + CAST(s_nationkey AS INT)) || 'x' || lpad(CAST(s_suppkey % 100000 AS STRING), 5, '0') AS pathway_id FROM supplier"


def directory_of(data: Inputs):
    return data.spark.sql(_DIRECTORY.replace("FROM supplier", "FROM {supplier}"), supplier=data.table("supplier"))


@query("organism_pathway_summary", """
SELECT organism, count(*) AS total, array_to_string(list(pathway_id ORDER BY line_no)[1:3], ';') AS preview, count(*) > 3 AS truncated FROM v_directory GROUP BY 1""", {"v_directory": _DIRECTORY})
def organism_pathway_summary(spark, sf):
    return Z.organism_pathway_summary(directory_of(Inputs(spark, sf)), 3).select("organism", "total", joined("preview"), "truncated")


@query("resolve_organisms", """
SELECT taxonomy_id AS input_identifier, 'taxonomy' AS namespace, t_number, code, taxonomy_id FROM v_genomes
UNION ALL SELECT name, 'name', t_number, code, taxonomy_id FROM v_genomes UNION ALL SELECT t_number, 'genome', t_number, code, taxonomy_id FROM v_genomes""")
def resolve_organisms(spark, sf):
    genomes = Inputs(spark, sf).view("v_genomes")
    parts = [Z.organism_identities(genomes.select(F.col(column).alias("input_identifier")).distinct(), genomes, namespace).withColumn("namespace", F.lit(namespace))
             for namespace, column in (("taxonomy", "taxonomy_id"), ("name", "name"), ("genome", "t_number"))]
    return union(*parts).select("input_identifier", "namespace", "t_number", "code", "taxonomy_id")


#: T-numbers and codes repeat on large tables, so a returned entry may answer several requests, each counted once.
_ALIASES = """
WITH g AS (SELECT DISTINCT CASE WHEN region_name = 'ASIA' THEN t_number ELSE code END AS requested_id FROM v_genomes),
p AS (SELECT 'genome' AS kind, t_number AS returned_id, requested_id FROM v_genomes JOIN g ON requested_id = t_number UNION SELECT 'genome', t_number, requested_id FROM v_genomes JOIN g ON requested_id = code
 UNION SELECT 'gene', CAST(s_suppkey AS VARCHAR), 'hsa:' || CAST(s_suppkey AS VARCHAR) FROM supplier)
SELECT kind, returned_id, min(requested_id) AS requested_id, CAST(count(*) AS INTEGER) AS matches, count(*) = 1 AS unique_match FROM p GROUP BY 1, 2"""


@query("match_entry_alias", _ALIASES)
def match_entry_alias(spark, sf):
    data = Inputs(spark, sf)
    genomes, supplier = data.view("v_genomes"), data.table("supplier")
    requests = genomes.selectExpr("'genome' as kind", "case when region_name = 'ASIA' then t_number else code end as identifier").unionByName(
        supplier.selectExpr("'gene' as kind", "'hsa:' || cast(s_suppkey as string) as identifier")).unionByName(
        supplier.selectExpr("'gene' as kind", "'mmu:' || cast(s_suppkey as string) as identifier"))
    returned = genomes.selectExpr("'genome' as kind", "t_number as identifier", "code as organism_code").unionByName(
        supplier.selectExpr("'gene' as kind", "cast(s_suppkey as string) as identifier", "'hsa' as organism_code"))
    return Z.match_entries(requests, returned).withColumn("matches", F.col("matches").cast("int"))


# --- search ------------------------------------------------------------------------------------

def search_table(data: Inputs):
    return data.view("v_flat_text").selectExpr(
        "case when kind in ('compound', 'gene') then 'compound' else kind end as database", "identifier", "p_name || ' ' || p_type as text",
        "'C' || p_size || 'H2O' as formula", "p_size * 10.25BD as exact_mass", "position")


@query("search_keyword", "SELECT identifier FROM v_flat_text WHERE kind = 'module' AND lower(p_name || ' ' || p_type) LIKE '%ring%' AND lower(p_name || ' ' || p_type) LIKE '%red%'")
def search_keyword(spark, sf):
    return Q.search_keyword(search_table(Inputs(spark, sf)), "module", "Red ring").select("identifier")


@query("search_keyword_postings", "SELECT identifier FROM v_flat_text WHERE kind = 'module' AND lower(p_name || ' ' || p_type) LIKE '%ring%' AND lower(p_name || ' ' || p_type) LIKE '%red%'")
def search_keyword_postings(spark, sf):
    """The same search by the rarest letter triples of its words."""
    table, folder = search_table(Inputs(spark, sf)), work_folder(spark, "postings")
    Q.write_postings(table, folder)
    return Q.search_postings(table, folder, "module", "Red ring").select("identifier")


@query("search_formula", "SELECT identifier FROM v_flat_text WHERE kind IN ('compound', 'gene') AND 'C' || p_size || 'H2O' LIKE '%C12H2%'")
def search_formula(spark, sf):
    return Q.search_formula(search_table(Inputs(spark, sf)), "compound", "C12H2").select("identifier")


@query("search_mass", "SELECT identifier, 'range' AS mode FROM v_flat_text WHERE kind IN ('compound', 'gene') AND p_size * 10.25 BETWEEN 100.5 AND 205 UNION ALL SELECT identifier, 'value' FROM v_flat_text WHERE kind IN ('compound', 'gene') AND p_size = 4")
def search_mass(spark, sf):
    table = search_table(Inputs(spark, sf))
    return Q.search_mass(table, "compound", "100.5-205").select("identifier", F.lit("range").alias("mode")).unionByName(
        Q.search_mass(table, "compound", "41.00").select("identifier", F.lit("value").alias("mode")))


@query("search_mass_layout", "SELECT identifier, 'range' AS mode FROM v_flat_text WHERE kind IN ('compound', 'gene') AND p_size * 10.25 BETWEEN 100.5 AND 205 UNION ALL SELECT identifier, 'value' FROM v_flat_text WHERE kind IN ('compound', 'gene') AND p_size = 4")
def search_mass_layout(spark, sf):
    """The same searches over a table written in the order of masses."""
    folder = work_folder(spark, "masses")
    Q.write_by_mass(search_table(Inputs(spark, sf)), folder)
    table = spark.read.parquet(folder)
    return Q.search_mass(table, "compound", "100.5-205").select("identifier", F.lit("range").alias("mode")).unionByName(
        Q.search_mass(table, "compound", "41.00").select("identifier", F.lit("value").alias("mode")))


@query("candidate_limit", """
SELECT kind AS database, identifier, candidate_no, observed, observed > 10 AS truncated FROM (SELECT kind, identifier, row_number() OVER (PARTITION BY kind ORDER BY position) AS candidate_no, count(*) OVER (PARTITION BY kind) AS observed FROM v_flat_text) AS t WHERE candidate_no <= 10""")
def candidate_limit(spark, sf):
    table = Inputs(spark, sf).view("v_flat_text").selectExpr("kind as database", "identifier", "position")
    return Q.candidate_limit(table, 10, "position", "database").select(
        "database", "identifier", F.col("candidate_no").cast("bigint").alias("candidate_no"), "observed", "truncated")


# --- snapshots ---------------------------------------------------------------------------------

_ITEMS = """
SELECT snapshot_id, database, identifier, 'modules' AS field, CASE WHEN snapshot_id = 'left' THEN 'M1|M2|M' || p_size WHEN p_size % 5 = 0 THEN 'M1|M3|M' || p_size ELSE 'M1|M2|M' || p_size END AS items FROM v_snapshot_entries
UNION ALL SELECT snapshot_id, database, identifier, 'definition', CASE WHEN snapshot_id = 'right' AND p_size % 7 = 0 THEN 'new ' ELSE '' END || p_name FROM v_snapshot_entries
UNION ALL SELECT snapshot_id, database, identifier, 'ko_identifiers', CASE WHEN snapshot_id = 'right' AND p_size % 3 = 0 THEN 'K1|K2' ELSE 'K1' END FROM v_snapshot_entries
UNION ALL SELECT snapshot_id, database, identifier, 'module_definition', p_type || snapshot_id FROM v_snapshot_entries WHERE database = 'module'
UNION ALL SELECT snapshot_id, database, identifier, 'extra', 'x' FROM v_snapshot_entries WHERE snapshot_id = 'left' AND p_size = 1"""
#: A field that several cards of one entry hold counts once, with the distinct lists joined in order.
_FIELDS = """SELECT snapshot_id, database, identifier, field, flatten(list(DISTINCT string_split(items, '|') ORDER BY string_split(items, '|'))) AS items FROM v_items GROUP BY ALL"""
_DIFF = """
WITH l AS (SELECT * FROM v_fields WHERE snapshot_id = 'left'), r AS (SELECT * FROM v_fields WHERE snapshot_id = 'right'),
le AS (SELECT DISTINCT database, identifier FROM l), re AS (SELECT DISTINCT database, identifier FROM r)
SELECT database, identifier, NULL AS field, 'entry_membership' AS category, 'entry_removed' AS change_type, '' AS added, '' AS removed FROM le ANTI JOIN re USING (database, identifier)
UNION ALL SELECT database, identifier, NULL, 'entry_membership', 'entry_added', '', '' FROM re ANTI JOIN le USING (database, identifier)
UNION ALL SELECT database, identifier, field, CASE WHEN database = 'module' AND field = 'module_definition' THEN 'module_definitions' WHEN database = 'pathway' AND field = 'ko_identifiers' THEN 'pathway_denominators' WHEN field IN ('modules', 'ko_identifiers') THEN 'relationships' ELSE 'entry_fields' END,
  CASE WHEN l.items IS NULL THEN 'field_added' WHEN r.items IS NULL THEN 'field_removed' ELSE 'field_modified' END,
  array_to_string(list_sort(list_distinct(list_filter(coalesce(r.items, []), lambda x: x <> '' AND NOT list_contains(coalesce(l.items, []), x)))), '|'),
  array_to_string(list_sort(list_distinct(list_filter(coalesce(l.items, []), lambda x: x <> '' AND NOT list_contains(coalesce(r.items, []), x)))), '|')
FROM l FULL JOIN r USING (database, identifier, field) SEMI JOIN le USING (database, identifier) SEMI JOIN re USING (database, identifier)
WHERE l.items IS DISTINCT FROM r.items AND NOT (database = 'module' AND field = 'definition')"""
_SNAP = {"v_items": _ITEMS, "v_fields": _FIELDS, "v_diff": _DIFF}


def snapshot_fields(data: Inputs):
    """Both snapshots' fields: one scan of the entries a side, one row per field by one explode."""
    right, size = F.col("snapshot_id") == "right", F.col("p_size")
    modules = F.when(right & (size % 5 == 0), F.array(F.lit("M1"), F.lit("M3"), F.concat(F.lit("M"), size))).otherwise(
        F.array(F.lit("M1"), F.lit("M2"), F.concat(F.lit("M"), size)))
    definition = F.concat(F.when(right & (size % 7 == 0), F.lit("new ")).otherwise(F.lit("")), "p_name")
    kos = F.when(right & (size % 3 == 0), F.array(F.lit("K1"), F.lit("K2"))).otherwise(F.array(F.lit("K1")))

    def field(name, items, given=None):
        row = F.struct(F.lit(name).alias("field"), F.transform(items, lambda x: x.cast("string")).alias("items"))
        return row if given is None else F.when(given, row)

    rows = F.array_compact(F.array(
        field("modules", modules), field("definition", F.array(definition)), field("ko_identifiers", kos),
        field("module_definition", F.array(F.concat("p_type", "snapshot_id")), F.col("database") == "module"),
        field("extra", F.array(F.lit("x")), ~right & (size == 1))))
    entries = data.view("v_snapshot_entries")
    return tuple(entries.filter(F.col("snapshot_id") == name).select("database", "identifier", F.inline(rows)) for name in ("left", "right"))


@query("snapshot_diff", "SELECT * FROM v_diff", _SNAP)
def snapshot_diff(spark, sf):
    left, right = snapshot_fields(Inputs(spark, sf))
    return D.snapshot_diff(left, right).withColumns({"added": joined("added", "|"), "removed": joined("removed", "|")})


@query("entry_added_removed", "SELECT database, identifier, change_type FROM v_diff WHERE field IS NULL", _SNAP)
def entry_added_removed(spark, sf):
    return D.entry_added_removed(*snapshot_fields(Inputs(spark, sf)))


@query("array_added_removed", "SELECT database, identifier, field, added, removed FROM v_diff WHERE change_type = 'field_modified'", _SNAP)
def array_added_removed(spark, sf):
    """Members of every array field that both snapshots of an entry hold and that differ."""
    changed = D.snapshot_diff(*snapshot_fields(Inputs(spark, sf))).filter("change_type = 'field_modified'")
    return changed.select("database", "identifier", "field", joined("added", "|").alias("added"), joined("removed", "|").alias("removed"))


@query("snapshot_dimension_counts", """
SELECT category, CAST(coalesce(changes, 0) AS BIGINT) AS changes, CAST(coalesce(changed_entries, 0) AS BIGINT) AS changed_entries FROM (SELECT unnest(['entry_fields', 'relationships', 'module_definitions', 'pathway_denominators']) AS category) d
LEFT JOIN (SELECT category, count(*) AS changes, count(DISTINCT (database, identifier)) AS changed_entries FROM v_diff WHERE field IS NOT NULL GROUP BY 1) c USING (category)""", _SNAP)
def snapshot_dimension_counts(spark, sf):
    return D.dimension_counts(D.snapshot_diff(*snapshot_fields(Inputs(spark, sf))))


@query("snapshot_source_summary", """
SELECT snapshot_id, count(*) AS batches, string_agg(DISTINCT endpoint_class, ';' ORDER BY endpoint_class) AS endpoint_classes, string_agg(DISTINCT endpoint_label, ';' ORDER BY endpoint_label) AS endpoint_labels,
  string_agg(DISTINCT database_release, ';' ORDER BY database_release) AS releases, count(DISTINCT endpoint_class) AS endpoint_class_count, count(DISTINCT endpoint_label) AS endpoint_label_count, count(DISTINCT database_release) AS release_count,
  min(endpoint_class) AS first_endpoint_class, min(database_release) AS first_database_release, max(database_release) AS last_database_release, count(database_release) AS labelled_batches,
  CAST(sum(CASE WHEN origin = 'network' THEN attempt_count ELSE 0 END) AS BIGINT) AS network_requests, count(*) FILTER (WHERE origin = 'cache') AS cache_hits, count(*) FILTER (WHERE is_stale) AS stale_batches,
  strftime(min(retrieved_at), '%Y-%m-%d %H:%M:%S') AS first_retrieved, (SELECT count(DISTINCT (database, identifier)) FROM v_snapshot_entries e WHERE e.snapshot_id = b.snapshot_id) AS entries,
  (SELECT count(*) FROM part WHERE CASE b.snapshot_id WHEN 'left' THEN p_type = 'PROMO' ELSE p_type = 'SMALL' END) AS missing_entries FROM v_batches b GROUP BY snapshot_id""")
def snapshot_source_summary(spark, sf):
    data = Inputs(spark, sf)
    missing = data.table("part").selectExpr("case p_type when 'PROMO' then 'left' when 'SMALL' then 'right' end as snapshot_id").filter("snapshot_id is not null")
    summary = D.source_summary(data.view("v_snapshot_entries"), missing, data.view("v_batches"))
    return summary.select("snapshot_id", "batches", *[F.array_join(name, ";").alias(name) for name in ("endpoint_classes", "endpoint_labels", "releases")],
                          "endpoint_class_count", "endpoint_label_count", "release_count", "first_endpoint_class", "first_database_release", "last_database_release",
                          "labelled_batches", "network_requests", "cache_hits", "stale_batches",
                          F.date_format("first_retrieved", "yyyy-MM-dd HH:mm:ss").alias("first_retrieved"), "entries", "missing_entries")


@query("snapshot_source_labels", """
SELECT DISTINCT snapshot_id, kind, label FROM (
  SELECT snapshot_id, 'endpoint_class' AS kind, CAST(endpoint_class AS VARCHAR) AS label FROM v_batches UNION ALL SELECT snapshot_id, 'endpoint_label', CAST(endpoint_label AS VARCHAR) FROM v_batches
  UNION ALL SELECT snapshot_id, 'database_release', CAST(database_release AS VARCHAR) FROM v_batches) AS t WHERE label IS NOT NULL""")
def snapshot_source_labels(spark, sf):
    """Every label of a snapshot's sources as a row."""
    return D.source_labels(Inputs(spark, sf).view("v_batches"))


@query("release_status", """
WITH s AS (SELECT list_sort(list(DISTINCT database_release) FILTER (WHERE snapshot_id = 'left' AND database_release IS NOT NULL)) AS l, list_sort(list(DISTINCT database_release) FILTER (WHERE snapshot_id = 'right' AND database_release IS NOT NULL)) AS r,
 count(*) FILTER (WHERE database_release IS NULL) AS m FROM v_batches) SELECT CASE WHEN m > 0 THEN 'partial' WHEN len(l) > 1 OR len(r) > 1 THEN 'mixed' WHEN l = r THEN 'same' ELSE 'different' END AS release_status FROM s""")
def release_status(spark, sf):
    return D.release_status(Inputs(spark, sf).view("v_batches"))


@query("context_compatible", """
SELECT (SELECT list_sort(list(DISTINCT endpoint_class || endpoint_label)) FROM v_batches WHERE snapshot_id = 'left') = (SELECT list_sort(list(DISTINCT endpoint_class || endpoint_label)) FROM v_batches WHERE snapshot_id = 'right') AS endpoint_compatible,
 (SELECT list_sort(list(DISTINCT origin || cache_state || is_stale)) FROM v_batches WHERE snapshot_id = 'left') = (SELECT list_sort(list(DISTINCT origin || cache_state || is_stale)) FROM v_batches WHERE snapshot_id = 'right') AS retrieval_compatible""")
def context_compatible(spark, sf):
    return D.context_compatible(Inputs(spark, sf).view("v_batches"))


@query("select_bundle", """
WITH chosen AS (SELECT DISTINCT database, identifier FROM v_snapshot_entries WHERE p_size > 25), held AS (SELECT database, identifier FROM v_snapshot_entries WHERE snapshot_id = 'left')
SELECT database, identifier, 'selected' AS state FROM held SEMI JOIN chosen USING (database, identifier) UNION ALL SELECT database, identifier, 'outside' FROM chosen ANTI JOIN held USING (database, identifier)""")
def select_bundle(spark, sf):
    entries = Inputs(spark, sf).view("v_snapshot_entries")
    cards, outside = D.select_bundle(entries.filter("snapshot_id = 'left'"), entries.filter("p_size > 25"))
    return cards.select("database", "identifier", F.lit("selected").alias("state")).unionByName(outside.withColumn("state", F.lit("outside")))
