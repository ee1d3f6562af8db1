"""Registered queries against DuckDB on keys so large that five-digit identifiers, codes and row numbers repeat."""

from __future__ import annotations

import duckdb
import pytest
from verify import check

from orthoflow.workload.views import TABLES

FOLDER = "/root/testdata/sf0.001"
DIGITS, LETTERS = 100_000, 26 ** 4  # shifts after which a key has the same five digits, or the same four letters, again
QUERIES_HERE = (
    "export_color",
    "export_manifest",
    "export_violations",
    "first_path_only",
    "organism_code_from_text",
    "match_entry_alias",
    "resolve_organisms",
    "select_bundle",
    "snapshot_diff",
    "array_added_removed",
    "snapshot_dimension_counts",
    "snapshot_source_summary",
    "records_by_ko",
    "records_by_sequence",
)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """The smallest tables, with a second copy of parts, customers and line items whose other columns differ."""
    made = tmp_path_factory.mktemp("large")
    source = {table: f"'{FOLDER}/{table}.parquet'" for table in TABLES}
    last = duckdb.sql(f"SELECT max(p_partkey) + 1 FROM {source['part']}").fetchall()[0][0]
    bodies = {
        "part": f"""SELECT * FROM {source['part']} UNION ALL SELECT k.p_partkey + {DIGITS}, a.p_name, CASE WHEN k.p_partkey % 2 = 0 THEN k.p_brand ELSE a.p_brand END, b.p_type, a.p_size, a.p_retailprice
  FROM {source['part']} k JOIN {source['part']} a ON a.p_partkey = (k.p_partkey // 4 * 4 + 4) % {last} JOIN {source['part']} b ON b.p_partkey = (k.p_partkey + 9) % {last}""",
        # 212,475 spells the reserved prefix pmid.
        "customer": f"""SELECT * FROM {source['customer']} UNION ALL SELECT c_custkey + s, 'Other ' || c_name, (c_nationkey + 3) % 25, c_acctbal, c_mktsegment FROM {source['customer']}, (VALUES ({DIGITS}), ({LETTERS})) AS v(s)
  UNION ALL SELECT k, 'Reserved ' || k, 1, 1.0, 'MACHINERY' FROM (SELECT 15 + 26 * 12 + 676 * 8 + 17576 * 3 AS k) AS t""",
        "lineitem": f"""SELECT * FROM {source['lineitem']} UNION ALL SELECT * REPLACE (l_suppkey + 1000 AS l_suppkey, l_partkey + 1000 AS l_partkey) FROM {source['lineitem']}""",
    }
    for table in TABLES:
        duckdb.sql(f"COPY ({bodies.get(table, f'SELECT * FROM {source[table]}')}) TO '{made}/{table}.parquet' (FORMAT PARQUET)")
    return str(made)


@pytest.fixture(scope="module")
def tables(folder):
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", QUERIES_HERE)
def test_query_matches_sql_where_identifiers_repeat(spark, tables, folder, name):
    outcome, _ = check(spark, tables, folder, name)
    assert outcome.startswith("ok"), outcome
