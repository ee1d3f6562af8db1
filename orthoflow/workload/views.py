"""Input views derived from the given tables.

``INPUT_SQL`` only shapes input data and is plain SQL that both engines read the same way.
``ORACLE_VIEWS`` adds SQL-only restatements of operator results that several queries check against;
the Spark side of those always goes through the library operators.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from orthoflow.session import CHECKPOINT_SETTING, HUGE_METHOD_LIMIT, HUGE_METHOD_SETTING, SPREAD_SETTING, ensure_checkpoint_dir

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)


# Tables whose rows are turned into text and parsed again.
PARSED_TABLES = ("lineitem", "part", "documents")
# Views whose few bytes a row become much text: their table and the key by which its rows are dealt to
# PARTS_PER_CORE tasks a core, as a split of the file would hold far too many of them.
DEALT_VIEWS = {"v_flat_text": ("part", "p_partkey")}
PARTS_PER_CORE = 4


def digits(expr: str, width: int = 5) -> str:
    return f"lpad(CAST(({expr}) % {10 ** width} AS STRING), {width}, '0')"


def ko(expr: str) -> str:
    return f"'K' || {digits(expr)}"


def letters(expr: str) -> str:
    """Four-letter organism code of a number."""
    parts = [f"chr(97 + CAST(floor(({expr}) / {26 ** i}.0) AS INT) % 26)" for i in range(4)]
    return "(" + " || ".join(parts) + ")"


_Q = "CAST(l_quantity AS INT)"
_D = "CAST(round(l_discount * 100) AS INT)"
_T = "CAST(round(l_tax * 100) AS INT)"
_ROW = "((l_orderkey * 8 + l_linenumber) * 1000000 + (l_partkey % 1000) * 1000 + l_suppkey % 1000)"


def _row_columns(copy: int) -> str:
    return f"""
  'D' || CAST(l_suppkey % 8 AS STRING) AS dataset_id,
  'S' || CAST(l_suppkey AS STRING) AS sample_id,
  {_ROW} * 2 + {copy} AS row_number,
  CASE WHEN l_orderkey % 101 = 0 THEN '  '
       WHEN l_orderkey % 103 = 0 THEN 'P' || chr(7) || CAST(l_orderkey AS STRING)
       ELSE 'P' || CAST(l_orderkey AS STRING) END AS seq_name,
  CASE l_partkey % 10 WHEN 0 THEN ' ko:' || {ko('l_partkey')}
       WHEN 1 THEN {ko('l_partkey')} || ' + ' || {ko('l_partkey + 1')}
       WHEN 2 THEN 'bad-' || CAST(l_partkey AS STRING)
       WHEN 3 THEN '' ELSE {ko('l_partkey')} END AS label,
  CASE WHEN l_partkey % 97 = 0 THEN '1.5' WHEN l_partkey % 89 = 0 THEN 'NaN'
       WHEN l_partkey % 83 = 0 THEN 'abc' WHEN l_partkey % 79 = 0 THEN ' '
       WHEN {_D} = 10 THEN '1.0' ELSE '0.' || CAST({_D} AS STRING) END AS score_text,
  CASE WHEN l_partkey % 73 = 0 THEN '' ELSE '0.' || CAST({_T} AS STRING) END AS threshold_text,
  CASE WHEN l_returnflag = 'A' THEN '*' WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'x' ELSE '' END AS mark,
  CASE WHEN l_returnflag = 'A' THEN ' Accepted' WHEN l_returnflag = 'R' THEN 'rejected' ELSE 'mystery' END AS decision,
  CAST(l_linenumber AS STRING) AS rank_text,
  CASE WHEN {_Q} % 3 = 0 THEN CAST(l_linenumber * 100 AS STRING) ELSE '' END AS start_text,
  CASE WHEN {_Q} % 3 <> 0 OR {_Q} % 5 = 0 THEN '' WHEN {_Q} % 7 = 0 THEN '0' WHEN {_Q} % 11 = 0 THEN '1'
       ELSE CAST(l_linenumber * 100 + {_Q} AS STRING) END AS end_text,
  l_linestatus AS note"""


_ENTRY_KIND = """CASE CAST(replace(p_brand, 'Brand#', '') AS INT) % 9
  WHEN 0 THEN 'ko' WHEN 1 THEN 'module' WHEN 2 THEN 'pathway' WHEN 3 THEN 'reaction' WHEN 4 THEN 'enzyme'
  WHEN 5 THEN 'compound' WHEN 6 THEN 'glycan' WHEN 7 THEN 'gene' ELSE 'genome' END"""

INPUT_SQL = {
    # Annotation rows as text cells; some source rows occur twice.
    "v_rows": f"SELECT {_row_columns(0)} FROM {{lineitem}} UNION ALL "
              f"SELECT {_row_columns(1)} FROM {{lineitem}} WHERE l_orderkey % 17 = 0",
    # One row per dataset / sample with declared context.
    "v_datasets": """
SELECT 'D' || CAST(k AS STRING) AS dataset_id, k AS input_index,
  CASE k WHEN 0 THEN 'isolate_genome' WHEN 1 THEN 'isolate_proteome' WHEN 2 THEN 'MAG' WHEN 3 THEN 'pangenome'
         WHEN 4 THEN 'metagenomic_community' WHEN 5 THEN 'mixed' ELSE 'unknown' END AS analysis_unit,
  CASE WHEN k < 6 THEN k + 9000 END AS taxon_id,
  CASE WHEN k % 3 = 0 THEN 'eco' END AS organism_code,
  'marker_threshold' AS policy_name, '1' AS policy_version
FROM (SELECT DISTINCT s_suppkey % 8 AS k FROM {supplier}) AS t""",
    "v_samples": f"""
SELECT 'S' || CAST(s_suppkey AS STRING) AS sample_id,
  CASE s_nationkey % 7 WHEN 0 THEN 'isolate_genome' WHEN 1 THEN 'isolate_proteome' WHEN 2 THEN 'MAG'
       WHEN 3 THEN 'pangenome' WHEN 4 THEN 'metagenomic_community' WHEN 5 THEN 'mixed' ELSE 'unknown' END AS analysis_unit,
  CASE WHEN s_nationkey % 7 < 2 THEN {letters('s_nationkey')} END AS organism_code,
  CASE WHEN s_acctbal > 0 THEN {letters('s_nationkey')} END AS gene_context_code
FROM {{supplier}}""",
    "v_sources": """
SELECT 'D' || CAST(s_suppkey % 8 AS STRING) AS dataset_id, s_suppkey AS source_no,
  CASE WHEN s_nationkey % 5 = 0 THEN 'manual' ELSE 'annotator' END AS source_name,
  CASE WHEN s_nationkey % 3 <> 0 THEN '2.' || CAST(s_nationkey % 2 AS STRING) END AS source_version,
  CASE WHEN s_nationkey % 4 <> 0 THEN 'model-' || CAST(s_nationkey % 4 AS STRING) END AS model_name,
  CASE WHEN s_nationkey % 6 <> 0 THEN '1' END AS model_version,
  CASE WHEN s_acctbal > 1000 THEN '2024-01-02T03:04:05Z' END AS annotation_date,
  CASE WHEN s_nationkey % 5 = 0 THEN 'plain_ko' ELSE 'detailed' END AS importer_name,
  '1' AS importer_version
FROM {supplier}""",
    # Relation rows between kinds of entities; repeated rows and one-to-many rows occur.
    "v_relations": f"""
SELECT 'ko_to_pathway' AS relationship, 'ko:' || {ko('p_partkey')} AS source_id, 'path:ko' || {digits('p_size')} AS target_id,
  p_partkey % 50 AS batch_index, p_partkey * 4 AS line_number FROM {{part}} WHERE p_type <> 'ECONOMY'
UNION ALL SELECT 'ko_to_pathway', 'ko:' || {ko('p_partkey')}, 'path:map' || {digits('p_size')}, p_partkey % 50, p_partkey * 4 + 1
  FROM {{part}} WHERE p_type IN ('LARGE', 'MEDIUM', 'PROMO')
UNION ALL SELECT 'ko_to_pathway', 'ko:' || {ko('p_partkey')}, 'path:ko' || {digits('p_size * 7 % 50 + 1')}, p_partkey % 50, p_partkey * 4 + 2
  FROM {{part}} WHERE p_type IN ('LARGE', 'SMALL')
UNION ALL SELECT 'ko_to_pathway', 'ko:' || {ko('p_partkey')}, 'path:ko01100', p_partkey % 50, p_partkey * 4 + 3
  FROM {{part}} WHERE p_type <> 'ECONOMY'
UNION ALL SELECT 'ko_to_module', 'ko:' || {ko('p_partkey')}, 'md:M' || {digits('p_size')}, p_partkey % 50, p_partkey * 2
  FROM {{part}} WHERE p_type <> 'SMALL'
UNION ALL SELECT 'ko_to_module', 'ko:' || {ko('p_partkey')}, 'module:M' || {digits('p_size % 50 + 11')}, p_partkey % 50, p_partkey * 2 + 1
  FROM {{part}} WHERE p_type IN ('LARGE', 'MEDIUM')
UNION ALL SELECT 'ko_to_reaction', 'ko:' || {ko('p_partkey')}, 'rn:R' || {digits('p_partkey % 5000')}, p_partkey % 50, p_partkey
  FROM {{part}} WHERE p_type <> 'PROMO'
UNION ALL SELECT 'ko_to_enzyme', 'ko:' || {ko('p_partkey')},
  'ec:' || CAST(p_partkey % 7 + 1 AS STRING) || '.' || CAST(p_size AS STRING) || '.' || replace(p_brand, 'Brand#', '') || '.-',
  p_partkey % 50, p_partkey FROM {{part}}""",
    "v_pathway_link": f"""
SELECT 'path:ko' || {digits('p_size')} AS source_id,
  CASE WHEN p_partkey % 41 = 0 THEN 'cpd:C00001' WHEN p_partkey % 43 = 0 THEN 'ko:bad' ELSE 'ko:' || {ko('p_partkey')} END AS target_id,
  p_partkey % 50 AS batch_index, p_partkey * 2 AS line_number FROM {{part}}
UNION ALL
SELECT 'path:ko' || {digits('p_size')},
  CASE WHEN p_partkey % 41 = 0 THEN 'cpd:C00001' WHEN p_partkey % 43 = 0 THEN 'ko:bad' ELSE 'ko:' || {ko('p_partkey')} END,
  p_partkey % 50, p_partkey * 2 + 1 FROM {{part}} WHERE p_type IN ('LARGE', 'PROMO')""",
    # Sizes 51..100 have no relation rows, so their denominator is empty.
    "v_pathways": f"""
SELECT 'ko' || {digits('n')} AS pathway_id, 'Pathway ' || CAST(n AS STRING) AS pathway_name,
  CASE WHEN n % 10 = 0 THEN 'Metabolism; Global and overview maps' ELSE 'Metabolism; Carbohydrate metabolism' END AS class_line,
  CASE WHEN n % 10 = 0 THEN 'ko' || {digits('n')} || ' Global Pathway' ELSE 'ko' || {digits('n')} || ' Pathway' END AS entry_line,
  'ko' AS reference_namespace
FROM (SELECT DISTINCT p_size AS n FROM {{part}} UNION SELECT DISTINCT p_size + 50 FROM {{part}}) AS t""",
    "v_pathway_requests": f"""
SELECT DISTINCT 'S' || CAST(l_suppkey AS STRING) AS sample_id,
  'ko' || {digits("CAST(l_quantity AS INT) + CASE WHEN l_returnflag = 'R' THEN 50 ELSE 0 END")} AS pathway_id FROM {{lineitem}}""",
    "v_set_pathway_requests": f"""
SELECT DISTINCT 'D' || CAST(l_suppkey % 8 AS STRING) AS dataset_id,
  'ko' || {digits("CAST(l_quantity AS INT) + CASE WHEN l_returnflag = 'R' THEN 50 ELSE 0 END")} AS pathway_id FROM {{lineitem}}""",
    "v_module_requests": f"""
SELECT DISTINCT 'S' || CAST(l_suppkey AS STRING) AS sample_id,
  'M' || {digits("CAST(l_quantity AS INT) + CASE WHEN l_returnflag = 'R' THEN 10 ELSE 0 END")} AS module_id FROM {{lineitem}}""",
    "v_set_module_requests": f"""
SELECT DISTINCT 'D' || CAST(l_suppkey % 8 AS STRING) AS dataset_id,
  'M' || {digits("CAST(l_quantity AS INT) + CASE WHEN l_returnflag = 'R' THEN 10 ELSE 0 END")} AS module_id FROM {{lineitem}}""",
    "v_modules": f"""
SELECT 'M' || {digits('n')} AS module_id, n, 'Module ' || CAST(n AS STRING) AS module_name,
  CASE n % 10
    WHEN 0 THEN {ko('n * 31')} || '-' || {ko('n * 31 + 1')} || ' ' || {ko('n * 31 + 4')}
    WHEN 1 THEN {ko('n * 31 + 4')} || ' (' || {ko('n * 31 + 5')} || ',' || {ko('n * 31 + 6')} || ')+' || {ko('n * 31 + 7')}
    WHEN 2 THEN 'M' || {digits('n + 1')} || ' ' || {ko('n * 31 + 4')}
    WHEN 3 THEN '(' || {ko('n * 31 + 5')} || ',' || {ko('n * 31 + 6')} || ')'
    WHEN 4 THEN '(M' || {digits('n - 1')} || ',' || {ko('n * 31 + 8')} || ') ' || {ko('n * 31 + 9')}
    WHEN 5 THEN 'M' || {digits('n')} || ' ' || {ko('n * 31 + 4')}
    WHEN 6 THEN {ko('n * 31 + 4')} || ' weird ' || {ko('n * 31 + 5')}
    WHEN 7 THEN {ko('n * 31 + 4')} || ' (' || {ko('n * 31 + 5')}
    WHEN 8 THEN '(M' || {digits('n + 900')} || ',' || {ko('n * 31 + 4')} || ') ' || {ko('n * 31 + 5')}
    ELSE {ko('n * 31 + 4')} || '+' || {ko('n * 31 + 5')} || ',' || {ko('n * 31 + 6')} || ' ' || {ko('n * 31 + 7')} || '-(' || {ko('n * 31 + 8')} || ' ' || {ko('n * 31 + 9')} || ')'
  END AS definition
FROM (SELECT DISTINCT p_size AS n FROM {{part}} UNION SELECT DISTINCT p_size + 10 FROM {{part}}) AS t""",
    # One hierarchy: regions, nations, customers. Line numbers grow but are not dense.
    "v_hierarchy_lines": f"""
SELECT 'br00001' AS hierarchy_id, CAST(r_regionkey AS BIGINT) * 1000000000000 AS line_no,
  'A' || {digits('r_regionkey + 9100')} || ' ' || r_name AS line FROM {{region}}
UNION ALL SELECT 'br00001', CAST(n_regionkey AS BIGINT) * 1000000000000 + (n_nationkey + 1) * CAST(10000000000 AS BIGINT), 'B  ' || n_name FROM {{nation}}
UNION ALL SELECT 'br00001', CAST(n_regionkey AS BIGINT) * 1000000000000 + (n_nationkey + 1) * CAST(10000000000 AS BIGINT) + c_custkey + 1,
  'C    C' || {digits('c_custkey')} || ' ' || c_name FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey""",
    "v_entities": f"""
SELECT DISTINCT CASE WHEN o_orderstatus = 'P' THEN 'glycan' ELSE 'compound' END AS kind,
  CASE WHEN o_orderstatus = 'P' THEN 'G' ELSE 'C' END || {digits('o_custkey')} AS identifier FROM {{orders}}""",
    "v_edges": f"""
SELECT 'compound_to_reaction' AS relationship, 'cpd:C' || {digits('o_custkey')} AS source_id, 'rn:R' || {digits('c_nationkey')} AS target_id,
  o_orderkey % 20 AS batch_index, o_orderkey AS line_number FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey
UNION ALL SELECT 'reaction_to_pathway', 'rn:R' || {digits('n_nationkey')}, 'path:ko' || {digits('n_regionkey')}, CAST(20 AS BIGINT), CAST(n_nationkey AS BIGINT) FROM {{nation}}
UNION ALL SELECT 'pathway_to_module', 'path:ko' || {digits('r_regionkey')}, 'md:M' || {digits('r_regionkey')}, CAST(21 AS BIGINT), CAST(r_regionkey AS BIGINT) FROM {{region}}
UNION ALL SELECT 'module_to_reaction', 'md:M' || {digits('n_regionkey')}, 'rn:R' || {digits('n_nationkey')}, CAST(22 AS BIGINT), CAST(n_nationkey AS BIGINT) FROM {{nation}}""",
    "v_seeds": f"SELECT 'compound' AS kind, 'C' || {digits('c_custkey')} AS identifier FROM {{customer}} WHERE c_mktsegment = 'BUILDING'",
    "v_genomes": f"""
SELECT 'T' || {digits('c_custkey')} AS t_number, {letters('c_custkey')} AS code, c_name AS name,
  'taxid:' || CAST(c_custkey + 1000 AS STRING) AS taxonomy_id, n_name AS nation_name, r_name AS region_name
FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey""",
    "v_taxonomy": """
SELECT 'taxid:' || CAST(c_custkey + 1000 AS STRING) AS taxonomy_id, 'species' AS rank, 'taxid:' || CAST(c_nationkey + 100 AS STRING) AS ancestor FROM {customer}
UNION ALL SELECT 'taxid:' || CAST(c_custkey + 1000 AS STRING), 'phylum', 'taxid:' || CAST(n_regionkey + 1 AS STRING)
  FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "v_crosswalk": """
SELECT DISTINCT 'ncbi-geneid:' || CAST(l_partkey + 1 AS STRING) AS source_id,
  CASE l_suppkey % 3 WHEN 0 THEN 'hsa:' WHEN 1 THEN 'mmu:' ELSE 'T00001:' END || CAST(l_suppkey AS STRING) AS target_id
FROM {lineitem}""",
    "v_gene_inputs": """
SELECT p_partkey AS position, CAST(p_partkey * 3 + 1 AS STRING) AS input_identifier FROM {part}""",
    "v_gene_relations": f"""
SELECT 'gene_to_ko' AS relationship, CASE s_suppkey % 3 WHEN 0 THEN 'hsa:' WHEN 1 THEN 'mmu:' ELSE 'T00001:' END || CAST(s_suppkey AS STRING) AS source_id,
  'ko:' || {ko('s_suppkey * 3')} AS target_id, s_suppkey % 9 AS batch_index, s_suppkey AS line_number FROM {{supplier}}
UNION ALL SELECT 'gene_to_pathway', CASE s_suppkey % 3 WHEN 0 THEN 'hsa:' WHEN 1 THEN 'mmu:' ELSE 'T00001:' END || CAST(s_suppkey AS STRING),
  'path:ko' || {digits('s_nationkey + 1')}, s_suppkey % 9, s_suppkey FROM {{supplier}}""",
    "v_substance_crosswalk": f"""
SELECT DISTINCT 'chebi:' || CAST(o_orderkey % 500 + 1 AS STRING) AS source_id, 'cpd:C' || {digits('o_custkey')} AS target_id FROM {{orders}}""",
    "v_batches": """
SELECT event_id AS batch_index, event_type AS operation, CASE WHEN user_id % 2 = 0 THEN 'network' ELSE 'cache' END AS origin,
  CASE WHEN user_id % 2 = 0 THEN 'miss' ELSE 'hit' END AS cache_state,
  ts AS retrieved_at, ts + INTERVAL 7 DAY AS expires_at, CAST(round(value * 100) AS BIGINT) AS response_bytes,
  CASE WHEN user_id % 3 <> 0 THEN '1' || CAST(user_id % 4 AS STRING) || '.0' END AS database_release,
  event_id % 3 + 1 AS attempt_count, event_type = 'error' AS is_stale,
  CASE WHEN user_id % 5 = 0 THEN 'licensed' ELSE 'public' END AS endpoint_class, 'endpoint-' || CAST(user_id % 5 AS STRING) AS endpoint_label,
  CASE WHEN user_id % 7 < 3 THEN 'left' ELSE 'right' END AS snapshot_id
FROM {events}""",
    # Flat-file entries: all kinds, repeated fields, continuation lines, an unknown field.
    "v_flat_text": f"""
SELECT p_partkey AS position, {_ENTRY_KIND} AS kind,
  rpad('ENTRY', 12, ' ') || CASE CAST(replace(p_brand, 'Brand#', '') AS INT) % 9 WHEN 0 THEN 'K' WHEN 1 THEN 'M' WHEN 2 THEN 'ko' WHEN 3 THEN 'R'
     WHEN 4 THEN 'EC 1.1.1.' WHEN 5 THEN 'C' WHEN 6 THEN 'G' WHEN 7 THEN '' ELSE 'T' END || {digits('p_partkey')} || '   ' || p_type || chr(10)
  || rpad('NAME', 12, ' ') || p_name || '; ' || p_type || ';' || chr(10) || rpad(' ', 12, ' ') || p_name || '; alias ' || CAST(p_partkey AS STRING) || chr(10)
  || rpad('DEFINITION', 12, ' ') || {ko('p_partkey')} || ' ' || {ko('p_partkey + 1')} || '-' || {ko('p_partkey + 2')} || ' [EC:1.' || CAST(p_size AS STRING) || '.1.1 2.1.1.-]' || chr(10)
  || rpad('CLASS', 12, ' ') || 'Class ' || p_brand || chr(10)
  || rpad('PATHWAY', 12, ' ') || 'map' || {digits('p_size')} || '  Pathway ' || CAST(p_size AS STRING) || chr(10) || rpad(' ', 12, ' ') || 'ko' || {digits('p_size + 1')} || '  Next' || chr(10)
  || rpad('MODULE', 12, ' ') || 'M' || {digits('p_size')} || '  Module name' || chr(10)
  || rpad('REACTION', 12, ' ') || 'R' || {digits('p_partkey')} || ',R' || {digits('p_partkey + 1')} || '  C00001 -> C00002' || chr(10)
  || rpad('ORTHOLOGY', 12, ' ') || {ko('p_partkey')} || '  first [EC:1.1.1.1]' || chr(10) || rpad(' ', 12, ' ') || {ko('p_partkey')} || '  again' || chr(10)
  || rpad('ENZYME', 12, ' ') || '1.1.1.' || CAST(p_size AS STRING) || '  2.' || CAST(p_size AS STRING) || '.-.-' || chr(10)
  || rpad('EQUATION', 12, ' ') || 'C' || {digits('p_partkey')} || ' + 2 C00002 <=> G' || {digits('p_size')} || ' + C' || {digits('p_partkey')} || chr(10)
  || rpad('RCLASS', 12, ' ') || 'RC' || {digits('p_size')} || '  C00001_C00002' || chr(10)
  || rpad('COMPOUND', 12, ' ') || 'C' || {digits('p_partkey')} || '  name' || chr(10)
  || rpad('GLYCAN', 12, ' ') || 'G' || {digits('p_size')} || '  name' || chr(10)
  || rpad('FORMULA', 12, ' ') || 'C' || CAST(p_size AS STRING) || 'H2O' || chr(10)
  || rpad('EXACT_MASS', 12, ' ') || CAST(p_size * 10 AS STRING) || '.25' || chr(10)
  || rpad('ORGANISM', 12, ' ') || 'hsa  Homo sapiens' || chr(10)
  || rpad('ORG_CODE', 12, ' ') || {letters('p_partkey')} || chr(10)
  || rpad('TAXONOMY', 12, ' ') || 'TAX:' || CAST(p_partkey + 1 AS STRING) || chr(10)
  || rpad('  LINEAGE', 12, ' ') || 'Indented ignored' || chr(10)
  || rpad('LINEAGE', 12, ' ') || 'Cellular; ' || p_brand || '; ' || p_type || chr(10)
  || rpad('DBLINKS', 12, ' ') || 'ChEBI: ' || CAST(p_partkey + 1 AS STRING) || ' ' || CAST(p_partkey + 2 AS STRING) || chr(10) || rpad(' ', 12, ' ') || 'PubChem: ' || CAST(p_partkey + 3 AS STRING) || chr(10)
  || rpad('REFERENCE', 12, ' ') || 'PMID:' || CAST(p_partkey % 700 + 1 AS STRING) || chr(10)
  || rpad('  AUTHORS', 12, ' ') || 'Someone A.' || chr(10)
  || rpad('REFERENCE', 12, ' ') || '2 PMID: ' || CAST(p_size AS STRING) || ' PMID:' || CAST(p_partkey % 700 + 1 AS STRING) || chr(10)
  || rpad('ODD_FIELD', 12, ' ') || 'kept' || chr(10) || '///' || chr(10) AS text,
  CASE CAST(replace(p_brand, 'Brand#', '') AS INT) % 9 WHEN 0 THEN 'K' || {digits('p_partkey')} WHEN 1 THEN 'M' || {digits('p_partkey')} WHEN 2 THEN 'ko' || {digits('p_partkey')}
     WHEN 3 THEN 'R' || {digits('p_partkey')} WHEN 4 THEN '1.1.1.' || {digits('p_partkey')} WHEN 5 THEN 'C' || {digits('p_partkey')} WHEN 6 THEN 'G' || {digits('p_partkey')}
     WHEN 7 THEN {digits('p_partkey')} ELSE 'T' || {digits('p_partkey')} END AS identifier,
  p_partkey, p_name, p_type, p_brand, p_size
FROM {{part}}""",
    # Two card snapshots in long form: one row per entry and field.
    "v_snapshot_entries": f"""
SELECT 'left' AS snapshot_id, {_ENTRY_KIND} AS database, 'E' || {digits('p_partkey')} AS identifier, p_partkey, p_size, p_type, p_name FROM {{part}} WHERE p_type <> 'PROMO'
UNION ALL SELECT 'right', {_ENTRY_KIND}, 'E' || {digits('p_partkey')}, p_partkey, p_size, p_type, p_name FROM {{part}} WHERE p_type <> 'SMALL'""",
    "v_uris": """
SELECT doc_id, CASE doc_id % 16 WHEN 0 THEN 'reads' WHEN 1 THEN '/data/' || source WHEN 2 THEN 'inline://host/' || source WHEN 3 THEN 'http://host/x'
  WHEN 4 THEN 'urn:sample:' || source WHEN 5 THEN 'a/../b' WHEN 6 THEN 'resource://user@host/' || lang WHEN 7 THEN 'resource://host/?q=' || lang
  WHEN 8 THEN 'C:/data' WHEN 9 THEN 'a b' WHEN 10 THEN '%41' WHEN 11 THEN 'dir/file' WHEN 12 THEN ' x' WHEN 13 THEN 'urn:x' WHEN 14 THEN 'mcp:x' ELSE '~home' END AS uri,
  CASE doc_id % 6 WHEN 0 THEN '2024-01-02T03:04:05Z' WHEN 1 THEN '2024-01-02T03:04:05+02:00' WHEN 2 THEN '2024-01-02T03:04:05' WHEN 3 THEN '2024-01-02'
  WHEN 4 THEN 'not a date' ELSE '2024-01-02T03:04Z' END AS date_text
FROM {documents}""",
}

# --- SQL-only restatements used by oracles -----------------------------------------------------

_WS = r"'^[ \t\n\r]+|[ \t\n\r]+$'"


def sql_strip(expr: str) -> str:
    return f"regexp_replace({expr}, {_WS}, '', 'g')"


def sql_ko(expr: str) -> str:
    return f"nullif(regexp_extract({sql_strip(expr)}, '^(?:[kK][oO]:)?(K[0-9]{{5}})$', 1), '')"


def sql_number(expr: str) -> str:
    return (f"CASE WHEN regexp_full_match({sql_strip(expr)}, '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?') "
            f"THEN CAST({sql_strip(expr)} AS DOUBLE) END")


def sql_positive(expr: str) -> str:
    return f"CASE WHEN regexp_full_match({sql_strip(expr)}, '0*[1-9][0-9]{{0,17}}') THEN CAST({sql_strip(expr)} AS BIGINT) END"


ORACLE_VIEWS = {name: body.format(**{table: table for table in TABLES}) for name, body in INPUT_SQL.items()}
ORACLE_VIEWS.update({
    "v_parsed": f"""
SELECT *, CASE WHEN regexp_full_match({sql_strip('label')}, 'K[0-9]{{5}}([ \\t]*\\+[ \\t]*K[0-9]{{5}})+')
    THEN regexp_split_to_array({sql_strip('label')}, '[ \\t]*\\+[ \\t]*') ELSE [label] END AS labels,
  CASE WHEN start_n IS NOT NULL AND end_n IS NOT NULL AND end_n >= start_n THEN start_n END AS domain_start,
  CASE WHEN start_n IS NOT NULL AND end_n IS NOT NULL AND end_n >= start_n THEN end_n END AS domain_end,
  CASE WHEN score_n BETWEEN 0 AND 1 THEN score_n END AS score,
  CASE WHEN threshold_n BETWEEN 0 AND 1 THEN threshold_n END AS threshold
FROM (SELECT *, {sql_strip('seq_name')} AS sequence_id,
    NOT ({sql_strip('seq_name')} <> '' AND NOT regexp_matches({sql_strip('seq_name')}, '[\\x00-\\x1F\\x7F]') AND length({sql_strip('seq_name')}) <= 256) AS skipped,
    {sql_number('score_text')} AS score_n, {sql_number('threshold_text')} AS threshold_n,
    {sql_positive('start_text')} AS start_n, {sql_positive('end_text')} AS end_n FROM v_rows) AS t""",
    "v_assign": f"""
SELECT *, CASE WHEN ko_id IS NULL AND trim(raw_ko) = '' THEN 'unclassified' WHEN ko_id IS NULL THEN 'invalid' WHEN mark = '*' THEN 'accepted'
    WHEN mark <> '' THEN 'unclassified' WHEN score IS NULL OR threshold IS NULL THEN 'unclassified' WHEN score >= threshold THEN 'accepted' ELSE 'rejected' END AS status,
  CASE WHEN ko_id IS NULL AND trim(raw_ko) = '' THEN 'missing_ko_prediction' WHEN ko_id IS NULL THEN 'invalid_ko_identifier' WHEN mark = '*' THEN 'source_acceptance_marker'
    WHEN mark <> '' THEN 'unrecognized_source_decision' WHEN score IS NULL OR threshold IS NULL THEN 'insufficient_decision_evidence'
    WHEN score >= threshold THEN 'meets_source_threshold' ELSE 'below_source_threshold' END AS reason
FROM (SELECT *, {sql_ko('raw_ko')} AS ko_id FROM (
  SELECT *, unnest(labels) AS raw_ko, generate_subscripts(labels, 1) - 1 AS pos FROM v_parsed WHERE NOT skipped) AS u) AS t""",
    "v_accepted": "SELECT DISTINCT sample_id, ko_id FROM v_assign WHERE status = 'accepted'",
    "v_accepted_sets": "SELECT DISTINCT dataset_id, ko_id FROM v_assign WHERE status = 'accepted'",
    "v_pathway_kos": """
SELECT DISTINCT split_part(source_id, ':', 2) AS pathway_id, split_part(target_id, ':', 2) AS ko_id FROM v_pathway_link
WHERE regexp_full_match(target_id, 'ko:K[0-9]{5}')""",
    "v_targets": """
SELECT relationship, split_part(source_id, ':', -1) AS ko_id,
  CASE relationship WHEN 'ko_to_pathway' THEN 'ko' || right(target_id, 5) ELSE split_part(target_id, ':', -1) END AS target_id,
  target_id AS raw_target, batch_index, line_number FROM v_relations""",
})


class Inputs:
    """The derived input views of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder
        spark.conf.set(HUGE_METHOD_SETTING, HUGE_METHOD_LIMIT)

    def table(self, name: str) -> DataFrame:
        """A given table, as Spark splits it.

        A session may set ``SPREAD_SETTING`` to a number of partitions over which the parsed tables are
        dealt first; that suits tables written as one row group, which Spark reads in one task. The
        setting alone decides, not the size of the input.
        """
        frame = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        spread = self.spark.conf.get(SPREAD_SETTING, None)
        return frame.repartition(int(spread)) if spread and name in PARSED_TABLES else frame

    def view(self, name: str) -> DataFrame:
        body = INPUT_SQL[name]
        used = {table: self.table(table) for table in TABLES if "{" + table + "}" in body}
        if name in DEALT_VIEWS:
            table, key = DEALT_VIEWS[name]
            parts = int(self.spark.conf.get(SPREAD_SETTING, None) or PARTS_PER_CORE * self.spark.sparkContext.defaultParallelism)
            used[table] = self.spark.read.parquet(f"{self.folder}/{table}.parquet").repartition(parts, key)
        return self.spark.sql(body, **used)

    def rows(self) -> DataFrame:
        """Annotation rows under the column names of the detailed format."""
        return self.view("v_rows").selectExpr(
            "dataset_id", "sample_id", "row_number", "seq_name as name", "label as predict_label",
            "score_text as probability", "threshold_text as threshold", "mark as annotate",
            "start_text as start", "end_text as end", "note")

    def parsed(self) -> DataFrame:
        from orthoflow.operators.intake import parse_detailed

        return parse_detailed(self.rows())

    def records(self) -> DataFrame:
        from orthoflow.operators.intake import detailed_records

        return detailed_records(self.parsed())

    def accepted_rows(self, key: str = "sample_id") -> DataFrame:
        from orthoflow.operators.evidence import accepted_rows

        return accepted_rows(self.records(), key)

    def accepted(self, key: str = "sample_id") -> DataFrame:
        from orthoflow.operators.evidence import accepted_kos

        return accepted_kos(self.records(), key)


def union(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    base = spark.conf.get(CHECKPOINT_SETTING, None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{base}/{name}-{uuid.uuid4().hex}"
