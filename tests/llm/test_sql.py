"""Corpus queries beside their SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest
import verify

from orthoflow.llm.queries import ORACLES, QUERIES
from orthoflow.workload.views import TABLES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, monkeypatch, name):
    monkeypatch.setattr(verify, "QUERIES", QUERIES)
    monkeypatch.setattr(verify, "ORACLES", ORACLES)
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    outcome, _ = verify.check(spark, con, FOLDER, name)
    assert outcome.startswith("ok"), outcome


def test_every_operator_has_a_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
