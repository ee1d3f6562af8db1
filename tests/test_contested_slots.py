"""Reports group only the records of contested slots and of repeated keys, with the counts of plain loops."""

from __future__ import annotations

import random

from orthoflow.operators import intake as K
from orthoflow.workload import QUERIES

SCHEMA = "dataset_id string, sample_id string, row_number long, pos int, sequence_id string, ko_id string, status string, domain_start long, domain_end long"


def test_slots_of_one_row_are_left_out_of_the_groups(spark):
    rows = [("d", "s", n, pos, f"p{n}", f"K{pos:05d}", "accepted", None, None) for n in range(300) for pos in range(2)]
    rows += [("d", "s", 1000 + n, 0, "p7", "K00009", "accepted", None, None) for n in range(3)]
    records = spark.createDataFrame(rows, SCHEMA)
    kept = {r.sequence_id for r in K.contested(records, K.sequence_or_domain_slot()).collect()}
    assert "p7" in kept and len(kept) < 10
    assert [tuple(r) for r in K.conflict_keys(records, K.sequence_or_domain_slot()).select("ko_id", "row_number", "conflict_records").collect()] == [("K00009", 1000, 1)]


def test_report_groups_no_cells_of_all_records(spark):
    """No exchange by the long keys of a slot or by the evidence of a record."""
    plan = QUERIES["import_report"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "evidence" in line]


def test_repeated_records_are_counted_as_a_loop_does(spark):
    draw = random.Random(3)
    cells = [(f"d{draw.randrange(2)}", draw.choice((None, "", "a", "a\"b")), draw.choice((None, 0.5, 0.25))) for _ in range(200)]
    frame = spark.createDataFrame(cells, "dataset_id string, ko_id string, score double")
    wanted = {d: sum(1 for c in cells if c[0] == d) - len({c for c in cells if c[0] == d}) for d in ("d0", "d1")}
    assert dict(map(tuple, K.duplicate_counts(frame, ("dataset_id", "ko_id", "score")).collect())) == wanted
