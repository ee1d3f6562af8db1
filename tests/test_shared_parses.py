"""Rows are parsed once for all parts of a query, and cells that sets share are formed before the join."""

from __future__ import annotations

import pytest

from orthoflow.operators import relations as R
from orthoflow.workload import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plan_of(spark, name):
    return QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ("evidence_audit", "import_report"))
def test_report_reads_columns_of_one_parse(spark, name):
    """The plan reads the written parse by columns: no annotation row and no whole-row checkpoint of it."""
    plan = plan_of(spark, name)
    assert "l_tax" not in plan and "written-" in plan


def test_summary_parses_rows_once(spark):
    assert "l_tax" not in plan_of(spark, "completion_summary_rows")


def test_relation_cells_are_formed_below_the_join(spark):
    plan = plan_of(spark, "write_target_relationships")
    assert plan.index("Join") < plan.index("regexp_extract")


def test_ranks_without_lists(spark):
    accepted = spark.createDataFrame([("S1", "K00001"), ("S1", "K00002"), ("S2", "K00002")], "sample_id string, ko_id string")
    edges = spark.createDataFrame([("K00001", "T2"), ("K00002", "T2"), ("K00002", "T1")], "ko_id string, target_id string")
    columns = ("sample_id", "target_id", "detected_kos", "relation_rows", "rank")
    bare = R.ranked_overlap(accepted, edges, limit=0)
    assert sorted(bare.select(*columns).collect()) == sorted(R.ranked_overlap(accepted, edges).select(*columns).collect())
    assert all(not r["ko_ids"] for r in bare.collect())
