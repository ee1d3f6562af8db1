"""Registered queries against DuckDB on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest
from verify import check

from orthoflow.workload import ORACLES, QUERIES
from orthoflow.workload.views import TABLES

FOLDER = "/root/testdata/sf0.001"
CHOSEN = (
    "policy_marker_threshold", "row_diagnostics", "conflicting_assignments", "import_report", "rank_pathways", "pathway_coverage",
    "mapping_yield", "ko_partial_patterns", "hierarchy_paths", "trace_relations", "mapping_status", "snapshot_diff", "scan_flat_file",
    "module_completion", "export_color", "missing_alternatives", "duplicate_records", "resolve_genes", "scan_quoted_records", "search_mass_layout",
)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_sql(spark, tables, name):
    outcome, _ = check(spark, tables, FOLDER, name)
    assert outcome.startswith("ok"), outcome


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
