"""Ranking, coverage, audit and comparison queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from orthoflow.functions import identifiers as I
from orthoflow.operators import audit as A
from orthoflow.operators import compare as C
from orthoflow.operators import coverage as V
from orthoflow.operators import relations as R
from orthoflow.workload.registry import query
from orthoflow.workload.views import Inputs, union

AUDITED = ("ko_to_pathway", "ko_to_module", "ko_to_reaction")


def joined(name: str, separator: str = ";"):
    return F.array_join(F.col(name).cast("array<string>"), separator).alias(name)


def times(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


# --- relations ---------------------------------------------------------------------------------

@query("accepted_relations", """
SELECT sample_id, ko_id, target_id, raw_target, batch_index, line_number FROM v_accepted JOIN v_targets USING (ko_id) WHERE relationship = 'ko_to_pathway'""")
def accepted_relations(spark, sf):
    data = Inputs(spark, sf)
    return R.accepted_relations(data.accepted(), R.normalized_relations(data.view("v_relations"), "ko_to_pathway")).select(
        "sample_id", "ko_id", "target_id", "raw_target", "batch_index", "line_number")


_OVERLAP = """
SELECT relationship, sample_id, target_id, count(DISTINCT ko_id) AS detected_kos, string_agg(DISTINCT ko_id, ';' ORDER BY ko_id) AS ko_ids, count(*) AS relation_rows
FROM v_accepted JOIN v_targets USING (ko_id) GROUP BY ALL"""
_RANKED = "SELECT *, row_number() OVER (PARTITION BY relationship, sample_id ORDER BY detected_kos DESC, target_id) AS rank FROM v_overlap"
_RANK_VIEWS = {"v_overlap": _OVERLAP, "v_ranked": _RANKED}


def overlap_of(data: Inputs, relationship: str):
    return R.target_overlap(data.accepted(), R.normalized_relations(data.view("v_relations"), relationship))


def ranked_of(data: Inputs, relationship: str):
    return R.ranked_overlap(data.accepted(), R.normalized_relations(data.view("v_relations"), relationship))


@query("target_overlap", "SELECT * EXCLUDE (relationship) FROM v_overlap WHERE relationship = 'ko_to_pathway'", _RANK_VIEWS)
def target_overlap(spark, sf):
    return overlap_of(Inputs(spark, sf), "ko_to_pathway").withColumn("ko_ids", joined("ko_ids"))


@query("rank_pathways", "SELECT sample_id, target_id AS pathway_id, rank, detected_kos, ko_ids, relation_rows FROM v_ranked WHERE relationship = 'ko_to_pathway'", _RANK_VIEWS)
def rank_pathways(spark, sf):
    return ranked_of(Inputs(spark, sf), "ko_to_pathway").select(
        "sample_id", F.col("target_id").alias("pathway_id"), F.col("rank").cast("bigint").alias("rank"), "detected_kos", joined("ko_ids"), "relation_rows")


@query("rank_modules", "SELECT sample_id, target_id AS module_id, rank, detected_kos, ko_ids, relation_rows FROM v_ranked WHERE relationship = 'ko_to_module'", _RANK_VIEWS)
def rank_modules(spark, sf):
    return ranked_of(Inputs(spark, sf), "ko_to_module").select(
        "sample_id", F.col("target_id").alias("module_id"), F.col("rank").cast("bigint").alias("rank"), "detected_kos", joined("ko_ids"), "relation_rows")


@query("top_n_pathways", """
SELECT sample_id, target_id AS pathway_id, rank FROM v_ranked WHERE relationship = 'ko_to_pathway' AND target_id <> 'ko01100'
QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY rank) <= 5""", _RANK_VIEWS)
def top_n_pathways(spark, sf):
    ranked = ranked_of(Inputs(spark, sf), "ko_to_pathway")
    return R.top_targets(ranked, excluded=R.BROAD_PATHWAYS).select(
        "sample_id", F.col("target_id").alias("pathway_id"), F.col("rank").cast("bigint").alias("rank"))


@query("top_n_modules", "SELECT sample_id, target_id AS module_id, rank FROM v_ranked WHERE relationship = 'ko_to_module' AND rank <= 5", _RANK_VIEWS)
def top_n_modules(spark, sf):
    return R.top_targets(ranked_of(Inputs(spark, sf), "ko_to_module")).select(
        "sample_id", F.col("target_id").alias("module_id"), F.col("rank").cast("bigint").alias("rank"))


@query("target_normalizer_plugin", """
SELECT sample_id, 'enzyme-class-' || substr(target_id, 1, 1) AS target_id, count(DISTINCT ko_id) AS detected_kos, count(*) AS relation_rows
FROM v_accepted JOIN v_targets USING (ko_id) WHERE relationship = 'ko_to_enzyme' GROUP BY 1, 2""")
def target_normalizer_plugin(spark, sf):
    """Targets reduced to the enzyme class by a user normalizer."""
    data = Inputs(spark, sf)
    classes = R.normalized_relations(data.view("v_relations"), "ko_to_enzyme",
                                     lambda raw: F.concat(F.lit("enzyme-class-"), F.substring(I.last_part(raw), 1, 1)))
    return R.target_overlap(data.accepted(), classes).drop("ko_ids")


_DEGREES = """
SELECT relationship, dataset_id, ko_id, count(DISTINCT target_id) AS targets, count(target_id) AS raw_rows FROM
 (SELECT * FROM v_accepted_sets, (SELECT unnest(['ko_to_pathway', 'ko_to_module', 'ko_to_reaction']) AS relationship)) a
 LEFT JOIN v_targets USING (relationship, ko_id) GROUP BY ALL"""


_YIELD = """
SELECT relationship, dataset_id, count(*) AS selected_kos, count(*) FILTER (WHERE targets > 0) AS mapped_kos, count(*) FILTER (WHERE targets = 0) AS unmapped_kos,
  count(*) FILTER (WHERE targets > 0) / count(*) AS mapping_yield, CAST(sum(raw_rows) AS BIGINT) AS raw_relation_rows, CAST(sum(targets) AS BIGINT) AS unique_relations,
  count(*) FILTER (WHERE targets > 1) AS one_to_many_kos FROM v_degrees GROUP BY ALL"""


@query("mapping_yield", _YIELD, {"v_degrees": _DEGREES})
def mapping_yield(spark, sf):
    data = Inputs(spark, sf)
    accepted = data.accepted("dataset_id")
    return R.mapping_yield(R.ko_degrees(accepted, data.view("v_relations"), AUDITED), AUDITED)


@query("target_degree_distribution", "SELECT relationship, dataset_id, targets AS target_count, count(*) AS ko_count FROM v_degrees WHERE targets > 0 GROUP BY ALL", {"v_degrees": _DEGREES})
def target_degree_distribution(spark, sf):
    data = Inputs(spark, sf)
    accepted = data.accepted("dataset_id")
    return R.target_degree_distribution(R.ko_degrees(accepted, data.view("v_relations"), AUDITED), AUDITED)


@query("accepted_without_relation", """
SELECT dataset_id, ko_id FROM v_accepted_sets WHERE ko_id NOT IN (SELECT ko_id FROM v_targets WHERE relationship = 'ko_to_pathway')""")
def accepted_without_relation(spark, sf):
    data = Inputs(spark, sf)
    return R.accepted_without_relation(data.accepted("dataset_id"), data.view("v_relations"), ("ko_to_pathway",)).select("dataset_id", "ko_id")


# --- coverage ----------------------------------------------------------------------------------

@query("canonical_pathway_id", """
SELECT source_id, raw, CASE WHEN raw LIKE 'rn%' THEN NULL WHEN raw LIKE 'map%' OR raw LIKE 'ko%' THEN 'ko' || right(raw, 5) ELSE raw END AS canonical,
  CASE WHEN raw LIKE 'rn%' THEN NULL WHEN raw LIKE 'map%' THEN 'map' WHEN raw LIKE 'ko%' THEN 'ko' ELSE 'organism' END AS namespace
FROM (SELECT p_partkey AS source_id, CASE p_partkey % 4 WHEN 0 THEN 'ko' WHEN 1 THEN 'map' WHEN 2 THEN 'hsa' ELSE 'rn' END || lpad(CAST(p_size AS VARCHAR), 5, '0') AS raw FROM part) AS t""")
def canonical_pathway_id(spark, sf):
    raw = Inputs(spark, sf).table("part").selectExpr(
        "p_partkey as source_id", "case p_partkey % 4 when 0 then 'ko' when 1 then 'map' when 2 then 'hsa' else 'rn' end || lpad(cast(p_size as string), 5, '0') as raw")
    return raw.select("source_id", "raw", I.canonical_pathway_id(F.col("raw")).alias("canonical"), I.pathway_namespace(F.col("raw")).alias("namespace"))


@query("canonical_pathway_specs", """
SELECT brand, first_position, pathway_id FROM (SELECT p_brand AS brand, min(p_partkey) OVER (PARTITION BY p_brand, g) AS first_position, raw AS pathway_id,
  row_number() OVER (PARTITION BY p_brand, g ORDER BY CASE WHEN raw LIKE 'ko%' THEN 0 ELSE 1 END, p_partkey) AS rn
  FROM (SELECT *, CASE WHEN raw LIKE 'hsa%' THEN raw ELSE right(raw, 5) END AS g FROM (SELECT *, CASE p_partkey % 3 WHEN 0 THEN 'ko' WHEN 1 THEN 'map' ELSE 'hsa' END || lpad(CAST(p_size AS VARCHAR), 5, '0') AS raw FROM part) AS x) AS u) AS t WHERE rn = 1""")
def canonical_pathway_specs(spark, sf):
    specs = Inputs(spark, sf).table("part").selectExpr(
        "p_brand as brand", "p_partkey as position", "case p_partkey % 3 when 0 then 'ko' when 1 then 'map' else 'hsa' end || lpad(cast(p_size as string), 5, '0') as pathway_id")
    return V.canonical_pathways(specs, "brand").select("brand", F.col("position").alias("first_position"), "pathway_id")


@query("pathway_scope", """
SELECT pathway_id, CASE WHEN class_line LIKE '%Global and overview maps%' THEN 'global_or_overview' ELSE 'standard' END AS scope FROM v_pathways""")
def pathway_scope(spark, sf):
    return Inputs(spark, sf).view("v_pathways").select("pathway_id", V.pathway_scope(F.col("class_line"), F.col("entry_line")).alias("scope"))


_REFERENCE = """
SELECT p.pathway_id, pathway_name, CASE WHEN class_line LIKE '%Global and overview maps%' THEN 'global_or_overview' ELSE 'standard' END AS scope,
  count(target_id) AS relation_rows, count(target_id) - count(DISTINCT target_id) AS duplicate_rows,
  count(DISTINCT target_id) FILTER (WHERE regexp_full_match(target_id, 'ko:K[0-9]{5}')) AS reference_kos,
  count(DISTINCT target_id) FILTER (WHERE NOT regexp_full_match(target_id, 'ko:K[0-9]{5}')) AS exclusions
FROM v_pathways p LEFT JOIN v_pathway_link l ON l.source_id = 'path:' || p.pathway_id GROUP BY ALL"""
_REF = {"v_reference": _REFERENCE}


def reference_of(data: Inputs):
    targets = V.link_targets(data.view("v_pathway_link"))
    return targets, V.build_reference(data.view("v_pathways"), targets)


@query("build_pathway_reference", _REFERENCE)
def build_pathway_reference(spark, sf):
    return reference_of(Inputs(spark, sf))[1].select("pathway_id", "pathway_name", "scope", "relation_rows", "duplicate_rows", "reference_kos", "exclusions")


@query("pathway_exclusions", """
SELECT DISTINCT substr(source_id, 6) AS pathway_id, target_id AS entry, CASE WHEN target_id LIKE 'ko:%' THEN 'invalid_identifier' ELSE 'non_ko_identifier' END AS exclusion_reason
FROM v_pathway_link WHERE NOT regexp_full_match(target_id, 'ko:K[0-9]{5}')""")
def pathway_exclusions(spark, sf):
    return V.pathway_exclusions(V.link_targets(Inputs(spark, sf).view("v_pathway_link")))


@query("pathway_reference_counts", "SELECT pathway_id, relation_rows, duplicate_rows, reference_kos, exclusions FROM v_reference WHERE relation_rows > 0", _REF)
def pathway_reference_counts(spark, sf):
    return V.reference_counts(V.link_targets(Inputs(spark, sf).view("v_pathway_link")))


@query("detected_kos", "SELECT sample_id, pathway_id, ko_id FROM v_pathway_requests JOIN v_pathway_kos USING (pathway_id) JOIN v_accepted USING (sample_id, ko_id)")
def detected_kos(spark, sf):
    data = Inputs(spark, sf)
    return V.detected_kos(data.view("v_pathway_requests"), data.accepted_rows(), V.pathway_kos(reference_of(data)[0])).select("sample_id", "pathway_id", "ko_id")


@query("missing_kos", "SELECT sample_id, pathway_id, ko_id FROM v_pathway_requests JOIN v_pathway_kos USING (pathway_id) ANTI JOIN v_accepted USING (sample_id, ko_id)")
def missing_kos(spark, sf):
    data = Inputs(spark, sf)
    return V.missing_kos(data.view("v_pathway_requests"), data.accepted_rows(), V.pathway_kos(reference_of(data)[0])).select("sample_id", "pathway_id", "ko_id")


def _coverage_sql(requests: str, accepted: str, key: str) -> str:
    return f"""
SELECT {key}, pathway_id, scope, reference_kos, exclusions, duplicate_rows, coalesce(d, 0) AS detected_kos, reference_kos - coalesce(d, 0) AS missing_kos,
  CASE WHEN reference_kos > 0 THEN coalesce(d, 0) / reference_kos END AS coverage_ratio, CASE WHEN reference_kos > 0 THEN 'evaluated' ELSE 'not_evaluable' END AS evaluation_status
FROM {requests} JOIN v_reference USING (pathway_id) LEFT JOIN (SELECT {key}, pathway_id, count(*) AS d FROM {accepted} JOIN v_pathway_kos USING (ko_id) GROUP BY ALL) AS h USING ({key}, pathway_id)"""


_COVER = {**_REF, "v_coverage": _coverage_sql("v_pathway_requests", "v_accepted", "sample_id"),
          "v_set_coverage": _coverage_sql("v_set_pathway_requests", "v_accepted_sets", "dataset_id")}
COVERAGE_COLUMNS = ("pathway_id", "scope", "reference_kos", "exclusions", "duplicate_rows", "detected_kos", "missing_kos", "coverage_ratio", "evaluation_status")


def coverage_of(data: Inputs, key: str = "sample_id", accepted=None):
    targets, reference = reference_of(data)
    requests = data.view("v_pathway_requests" if key == "sample_id" else "v_set_pathway_requests")
    return V.coverage(requests, accepted or data.accepted(key), V.pathway_kos(targets), reference, key)


@query("pathway_coverage", "SELECT * FROM v_coverage", _COVER)
def pathway_coverage(spark, sf):
    return coverage_of(Inputs(spark, sf)).select("sample_id", *COVERAGE_COLUMNS)


@query("batch_pathways", "SELECT dataset_id, pathway_id, detected_kos, reference_kos, coverage_ratio, evaluation_status FROM v_set_coverage", _COVER)
def batch_pathways(spark, sf):
    """All requested pathways of all pooled datasets in one plan."""
    return coverage_of(Inputs(spark, sf), "dataset_id").select("dataset_id", "pathway_id", "detected_kos", "reference_kos", "coverage_ratio", "evaluation_status")


@query("bounded_preview", """
SELECT sample_id, pathway_id, array_to_string(list(ko_id ORDER BY ko_id)[1:3], ';') AS preview, count(*) AS n, count(*) > 3 AS truncated
FROM v_pathway_requests JOIN v_pathway_kos USING (pathway_id) JOIN v_accepted USING (sample_id, ko_id) GROUP BY ALL""")
def bounded_preview(spark, sf):
    data = Inputs(spark, sf)
    return V.previews(data.view("v_pathway_requests"), data.accepted(), V.pathway_kos(reference_of(data)[0]), 3).withColumn("preview", joined("preview"))


_PAIRS = """
SELECT r.sample_id, p.pathway_id, scope, analysis_unit, organism_code, gene_context_code, CASE right(p.pathway_id, 1) WHEN '1' THEN 'organism' WHEN '2' THEN 'map' ELSE 'ko' END AS reference_namespace,
  'ko' AS other, CASE WHEN right(p.pathway_id, 1) = '1' THEN coalesce(organism_code, 'zzz') END AS pathway_organism_code,
  CASE right(p.pathway_id, 1) WHEN '1' THEN 'organism' ELSE 'ko' END AS requested_namespace
FROM v_pathway_requests r JOIN v_samples s ON r.sample_id = s.sample_id JOIN v_reference p ON p.pathway_id = r.pathway_id"""


@query("coverage_eligibility", """
SELECT sample_id, pathway_id, CASE WHEN reference_namespace <> requested_namespace THEN 'namespace_mismatch' WHEN scope = 'global_or_overview' THEN 'broad_reference_needs_opt_in'
  WHEN reference_namespace = 'organism' AND gene_context_code IS NULL THEN 'missing_gene_context' WHEN reference_namespace = 'organism' AND analysis_unit NOT LIKE 'isolate%' THEN 'unit_not_isolate'
  WHEN reference_namespace = 'organism' AND (pathway_organism_code IS DISTINCT FROM organism_code OR pathway_organism_code <> gene_context_code) THEN 'organism_code_mismatch' END AS rejection FROM v_pairs""",
       {**_REF, "v_pairs": _PAIRS})
def coverage_eligibility(spark, sf):
    data = Inputs(spark, sf)
    last = F.right(F.col("pathway_id"), F.lit(1))
    pairs = data.view("v_pathway_requests").join(data.view("v_samples"), "sample_id").join(reference_of(data)[1].drop("reference_namespace"), "pathway_id")
    pairs = pairs.withColumns({
        "reference_namespace": F.when(last == "1", F.lit("organism")).when(last == "2", F.lit("map")).otherwise(F.lit("ko")),
        "requested_namespace": F.when(last == "1", F.lit("organism")).otherwise(F.lit("ko")),
        "pathway_organism_code": F.when(last == "1", F.coalesce("organism_code", F.lit("zzz"))),
    })
    return V.eligibility(pairs).select("sample_id", "pathway_id", "rejection")


_STALE = """SELECT substr(source_id, 6) AS pathway_id, bool_or(is_stale) AS is_stale FROM v_pathway_link JOIN v_batches USING (batch_index) GROUP BY 1"""


@query("coverage_warnings", """
SELECT sample_id, pathway_id, array_to_string(list_filter(['DESCRIPTIVE_RATIO', CASE WHEN reference_kos = 0 THEN 'NO_REFERENCE_KOS' END, CASE WHEN scope <> 'standard' THEN 'GLOBAL_OR_OVERVIEW_REFERENCE' END,
  CASE WHEN is_stale THEN 'STALE_REFERENCE' END, CASE WHEN exclusions > 0 THEN 'REFERENCE_EXCLUSIONS' END, CASE WHEN duplicate_rows > 0 THEN 'DUPLICATE_RELATIONSHIPS' END,
  CASE analysis_unit WHEN 'isolate_genome' THEN 'ISOLATE_GENOME_CONTEXT' WHEN 'isolate_proteome' THEN 'ISOLATE_PROTEOME_CONTEXT' WHEN 'MAG' THEN 'MAG_CONTEXT' WHEN 'pangenome' THEN 'PANGENOME_CONTEXT'
    WHEN 'metagenomic_community' THEN 'METAGENOMIC_COMMUNITY_CONTEXT' WHEN 'mixed' THEN 'MIXED_CONTEXT' ELSE 'UNKNOWN_CONTEXT' END,
  CASE WHEN detected_kos > 5 THEN 'DETECTED_PREVIEW_TRUNCATED' END, CASE WHEN missing_kos > 5 THEN 'MISSING_PREVIEW_TRUNCATED' END, CASE WHEN exclusions > 5 THEN 'EXCLUSION_PREVIEW_TRUNCATED' END], lambda x: x IS NOT NULL), ';') AS warnings
FROM v_coverage JOIN v_samples USING (sample_id) LEFT JOIN v_stale USING (pathway_id)""", {**_COVER, "v_stale": _STALE})
def coverage_warnings(spark, sf):
    data = Inputs(spark, sf)
    stale = V.stale_pathways(data.view("v_pathway_link"), data.view("v_batches"))
    rows = coverage_of(data).join(data.view("v_samples"), "sample_id").join(stale, "pathway_id", "left")
    return rows.select("sample_id", "pathway_id", F.array_join(V.warning_codes(5), ";").alias("warnings"))


@query("provenance_stale_flag", "SELECT pathway_id, is_stale FROM v_stale", {"v_stale": _STALE})
def provenance_stale_flag(spark, sf):
    data = Inputs(spark, sf)
    return V.stale_pathways(data.view("v_pathway_link"), data.view("v_batches"))


# --- audit -------------------------------------------------------------------------------------

_SOURCE_WARNINGS = """
SELECT dataset_id, code, affected FROM (
  SELECT dataset_id, count(*) FILTER (WHERE source_version IS NULL) AS a, count(*) FILTER (WHERE model_name IS NULL AND importer_name <> 'plain_ko') AS b,
    count(*) FILTER (WHERE model_version IS NULL AND importer_name <> 'plain_ko') AS c, count(*) FILTER (WHERE annotation_date IS NULL) AS d,
    CASE WHEN count(DISTINCT (source_name, source_version, model_name, model_version)) > 1 THEN count(*) ELSE 0 END AS e FROM v_sources GROUP BY 1) AS t,
  LATERAL (VALUES ('missing_source_version', a), ('missing_model_name', b), ('missing_model_version', c), ('missing_annotation_date', d), ('mixed_annotation_pipelines', e)) AS v(code, affected)
WHERE affected > 0"""
_BATCH_WARNINGS = """
SELECT code, affected FROM (SELECT 'release_unavailable' AS code, count(*) FILTER (WHERE database_release IS NULL) AS affected FROM v_batches
  UNION ALL SELECT 'stale_response', count(*) FILTER (WHERE is_stale) FROM v_batches) AS t WHERE affected > 0"""

@query("source_audit_warnings", """
SELECT * FROM v_source_warnings UNION ALL SELECT 'batches', code, affected FROM v_batch_warnings
UNION ALL SELECT dataset_id, 'incomplete_assembly_context', 1 FROM v_datasets WHERE input_index % 3 > 0
UNION ALL SELECT dataset_id, 'contamination_context', 1 FROM v_datasets WHERE input_index % 2 > 0""", {"v_source_warnings": _SOURCE_WARNINGS, "v_batch_warnings": _BATCH_WARNINGS})
def source_audit_warnings(spark, sf):
    data = Inputs(spark, sf)
    quality = data.view("v_datasets").selectExpr("dataset_id", "100.0D - input_index % 3 as completeness", "cast(input_index % 2 as double) as contamination")
    return union(A.source_warnings(data.view("v_sources")), A.batch_warnings(data.view("v_batches")).withColumn("dataset_id", F.lit("batches")),
                 A.quality_warnings(quality))


@query("audit_job", """
SELECT 'evidence' AS section, dataset_id, 'accepted_unique_kos' AS item, count(*) AS n FROM v_accepted_sets GROUP BY 2
UNION ALL SELECT 'mapping', dataset_id, relationship || ':mapped', count(*) FILTER (WHERE targets > 0) FROM v_degrees GROUP BY ALL
UNION ALL SELECT 'mapping', dataset_id, relationship || ':unmapped', count(*) FILTER (WHERE targets = 0) FROM v_degrees GROUP BY ALL
UNION ALL SELECT 'warning', dataset_id, code, affected FROM v_source_warnings
UNION ALL SELECT 'without_relation', dataset_id, 'any', count(*) FROM v_accepted_sets WHERE ko_id NOT IN (SELECT ko_id FROM v_targets WHERE relationship IN ('ko_to_pathway', 'ko_to_module', 'ko_to_reaction')) GROUP BY 2""",
       {"v_degrees": _DEGREES, "v_source_warnings": _SOURCE_WARNINGS})
def audit_job(spark, sf):
    from orthoflow.plans.audit import audit_annotation

    data = Inputs(spark, sf)
    return audit_annotation(data.records(), data.view("v_relations"), data.view("v_sources"), AUDITED)


@query("retrieval_summary", """
SELECT operation, count(*) AS batches, CAST(sum(CASE WHEN origin = 'network' THEN attempt_count ELSE 0 END) AS BIGINT) AS network_requests, count(*) FILTER (WHERE origin = 'cache') AS cache_hits,
  count(*) FILTER (WHERE is_stale) AS stale_batches, CAST(sum(response_bytes) AS BIGINT) AS response_bytes, count(DISTINCT database_release) AS release_count,
  string_agg(DISTINCT database_release, ';' ORDER BY database_release) AS releases, strftime(min(retrieved_at), '%Y-%m-%d %H:%M:%S') AS first_retrieved, strftime(max(retrieved_at), '%Y-%m-%d %H:%M:%S') AS last_retrieved
FROM v_batches GROUP BY 1""")
def retrieval_summary(spark, sf):
    summary = A.retrieval_summary(Inputs(spark, sf).view("v_batches"), "operation")
    return summary.withColumns({"releases": joined("releases"), "first_retrieved": times("first_retrieved"), "last_retrieved": times("last_retrieved")})


@query("freshness_summary", """
SELECT count(*) AS entries, count(*) FILTER (WHERE expires_at <= TIMESTAMP '2024-01-15 00:00:00') AS expired_entries, CAST(sum(response_bytes) AS BIGINT) AS payload_bytes FROM v_batches""")
def freshness_summary(spark, sf):
    batches = Inputs(spark, sf).view("v_batches").withColumn("expires_at", F.col("expires_at").cast("timestamp_ntz"))
    return A.freshness_summary(batches, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))


@query("batch_dedupe", """
SELECT DISTINCT operation, origin, cache_state, database_release, attempt_count, is_stale, endpoint_class, endpoint_label FROM v_batches""")
def batch_dedupe(spark, sf):
    return A.dedupe_batches(Inputs(spark, sf).view("v_batches").select(
        "operation", "origin", "cache_state", "database_release", "attempt_count", "is_stale", "endpoint_class", "endpoint_label"))


# --- comparison --------------------------------------------------------------------------------

_MEMBERS = """
SELECT ko_id, string_agg(CAST(input_index AS VARCHAR), ';' ORDER BY input_index) AS members, count(*) AS k, (SELECT count(*) FROM v_datasets) AS n
FROM v_accepted_sets JOIN v_datasets USING (dataset_id) GROUP BY 1"""
_PART = "CASE WHEN k = n THEN 'shared_by_all' WHEN k = 1 THEN 'set_specific' ELSE 'partially_shared' END"
_MEM = {"v_members": _MEMBERS}


def sets_of(data: Inputs):
    inputs = data.view("v_datasets")
    return data.accepted("dataset_id").join(inputs.select("dataset_id", "input_index"), "dataset_id"), inputs


def members_of(data: Inputs):
    sets, inputs = sets_of(data)
    return C.with_input_count(C.membership(sets), inputs)


@query("ko_union", "SELECT DISTINCT ko_id FROM v_accepted_sets")
def ko_union(spark, sf):
    return C.ko_union(sets_of(Inputs(spark, sf))[0])


@query("ko_shared_by_all", "SELECT ko_id FROM v_members WHERE k = n", _MEM)
def ko_shared_by_all(spark, sf):
    return C.shared_by_all(*sets_of(Inputs(spark, sf)))


@query("ko_set_specific", """
SELECT min(input_index) AS input_index, ko_id FROM (SELECT DISTINCT input_index, ko_id FROM v_assign JOIN v_datasets USING (dataset_id) WHERE status = 'rejected') AS t GROUP BY ko_id HAVING count(*) = 1""")
def ko_set_specific(spark, sf):
    """On the rejected sets, where some KOs do occur in one dataset only."""
    from orthoflow.operators.evidence import rejected_kos

    data = Inputs(spark, sf)
    return C.set_specific(rejected_kos(data.records()).join(data.view("v_datasets").select("dataset_id", "input_index"), "dataset_id"))


@query("ko_partial_patterns", "SELECT members, string_agg(ko_id, ';' ORDER BY ko_id) AS ko_ids, count(*) AS n FROM v_members m WHERE k > 1 AND k < m.n GROUP BY 1", _MEM)
def ko_partial_patterns(spark, sf):
    return C.partial_patterns(members_of(Inputs(spark, sf))).select(joined("members"), joined("ko_ids"), "n")


@query("compare_ko_sets", f"SELECT ko_id, {_PART} AS part, members, 1 AS policy_count FROM v_members", _MEM)
def compare_ko_sets(spark, sf):
    sets, inputs = sets_of(Inputs(spark, sf))
    policies = C.require_one_policy(inputs)
    return C.compare_ko_sets(sets, inputs).select("ko_id", "part", joined("members"), F.lit(policies).alias("policy_count"))


@query("summarize_comparison", f"""
SELECT part, members, count(*) AS n, array_to_string(list(ko_id ORDER BY ko_id)[1:4], ';') AS preview, count(*) > 4 AS truncated FROM (SELECT *, {_PART} AS part FROM v_members) AS t GROUP BY 1, 2""", _MEM)
def summarize_comparison(spark, sf):
    sets, inputs = sets_of(Inputs(spark, sf))
    return C.summarize_comparison(C.compare_ko_sets(sets, inputs), 4).select("part", joined("members"), "n", joined("preview"), "truncated")


@query("dataset_provenance", """
SELECT dataset_id, input_index, record_count, sample_count, unique_kos FROM v_datasets JOIN (SELECT dataset_id, count(*) AS record_count, count(DISTINCT sample_id) AS sample_count FROM v_assign GROUP BY 1) a USING (dataset_id)
JOIN (SELECT dataset_id, count(*) AS unique_kos FROM v_accepted_sets GROUP BY 1) u USING (dataset_id)""")
def dataset_provenance(spark, sf):
    data = Inputs(spark, sf)
    sets, inputs = sets_of(data)
    return C.dataset_provenance(inputs, data.records(), sets)


@query("dataset_sample_labels", "SELECT dataset_id, sample_id, min(row_number) AS first_row FROM v_assign GROUP BY 1, 2")
def dataset_sample_labels(spark, sf):
    return C.sample_labels(Inputs(spark, sf).records())


@query("comparison_warnings", """
WITH f AS (SELECT d.*, (SELECT string_agg(coalesce(source_name, '-') || coalesce(source_version, '-') || coalesce(model_name, '-') || coalesce(model_version, '-') || importer_name || importer_version, ',' ORDER BY source_no) FROM v_sources s WHERE s.dataset_id = d.dataset_id) AS sig,
  (SELECT count(DISTINCT sample_id) FROM v_assign a WHERE a.dataset_id = d.dataset_id) AS samples FROM v_datasets d),
w AS (SELECT string_agg(CAST(input_index AS VARCHAR), ';' ORDER BY input_index) AS everyone, count(DISTINCT sig) AS sigs, count(DISTINCT analysis_unit) AS units, count(DISTINCT (taxon_id, organism_code)) AS contexts,
  string_agg(CAST(input_index AS VARCHAR), ';' ORDER BY input_index) FILTER (WHERE analysis_unit IN ('unknown', 'mixed')) AS u, string_agg(CAST(input_index AS VARCHAR), ';' ORDER BY input_index) FILTER (WHERE analysis_unit = 'metagenomic_community') AS m,
  string_agg(CAST(input_index AS VARCHAR), ';' ORDER BY input_index) FILTER (WHERE analysis_unit = 'pangenome') AS p, string_agg(CAST(input_index AS VARCHAR), ';' ORDER BY input_index) FILTER (WHERE analysis_unit = 'MAG') AS g,
  string_agg(CAST(input_index AS VARCHAR), ';' ORDER BY input_index) FILTER (WHERE samples > 1) AS x FROM f)
SELECT code, affected FROM w, LATERAL (VALUES ('DETERMINISTIC_SET_DIFFERENCE_ONLY', ''), ('ANNOTATION_ABSENCE_NOT_BIOLOGICAL_ABSENCE', ''), ('ANNOTATION_PIPELINE_MISMATCH', CASE WHEN sigs > 1 THEN everyone END),
  ('ANALYSIS_UNIT_MISMATCH', CASE WHEN units > 1 THEN everyone END), ('TAXONOMIC_CONTEXT_MISMATCH', CASE WHEN contexts > 1 THEN everyone END), ('UNKNOWN_OR_MIXED_ANALYSIS_UNIT', u), ('POOLED_COMMUNITY_POTENTIAL', m),
  ('POOLED_PANGENOME_POTENTIAL', p), ('MAG_QUALITY_SENSITIVE', g), ('MULTI_SAMPLE_DATASET', x)) AS v(code, affected) WHERE affected IS NOT NULL""")
def comparison_warnings(spark, sf):
    data = Inputs(spark, sf)
    return C.comparison_warnings(data.view("v_datasets"), data.view("v_sources"), data.records()).select("code", joined("affected"))


_COMPARED = """
SELECT pathway_id, count(*) AS compared_inputs, count(DISTINCT coalesce(CAST(coverage_ratio AS VARCHAR), '') || evaluation_status || detected_kos || ':' || reference_kos) > 1 AS outcomes_differ,
  coalesce(string_agg(CAST(input_index AS VARCHAR), ';' ORDER BY input_index) FILTER (WHERE evaluation_status = 'evaluated'), '') AS evaluated_in,
  coalesce(string_agg(CAST(input_index AS VARCHAR), ';' ORDER BY input_index) FILTER (WHERE evaluation_status = 'not_evaluable'), '') AS not_evaluable_in
FROM v_set_coverage JOIN v_datasets USING (dataset_id) GROUP BY 1"""


def compared_pathways(data: Inputs):
    outcomes = coverage_of(data, "dataset_id").join(data.view("v_datasets").select("dataset_id", "input_index"), "dataset_id")
    return C.compare_outcomes(outcomes, "pathway_id", ("coverage_ratio", "evaluation_status", "detected_kos", "reference_kos"), "evaluation_status")


@query("compare_pathways", _COMPARED, _COVER)
def compare_pathways(spark, sf):
    return compared_pathways(Inputs(spark, sf))


@query("compare_sets_job", f"""
SELECT 'ko' AS section, ko_id AS item, {_PART} || ':' || members AS value FROM v_members
UNION ALL SELECT 'pathway', pathway_id, CASE WHEN outcomes_differ THEN 'differ' ELSE 'same' END FROM v_compared""", {**_MEM, **_COVER, "v_compared": _COMPARED})
def compare_sets_job(spark, sf):
    from orthoflow.plans.compare import compare_sets

    data = Inputs(spark, sf)
    sets, inputs = sets_of(data)
    return compare_sets(sets, inputs, compared_pathways(data))
