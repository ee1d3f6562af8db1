"""Sessions with more shuffle partitions than parts keep the deal: pairs of KOs and targets are never shuffled."""

from __future__ import annotations

import pytest

from orthoflow.operators import coverage as V
from orthoflow.operators import spread
from orthoflow.workload import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def many_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("name", ("missing_kos", "detected_kos", "overlay_graphics", "rank_pathways"))
def test_no_exchange_above_a_join_of_pairs(many_partitions, name):
    frame = QUERIES[name](many_partitions, FOLDER)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "ShuffledHashJoin" in line]
    deals = [line for line in plan.splitlines() if "Exchange hashpartitioning(_part" in line]
    parts = spread.parts_of(frame)
    assert joins and deals and all(f", {parts})" in line and line.count("#") == 1 for line in deals), deals
    first_exchange = plan.index("Exchange ")
    assert all(plan.index(line) < first_exchange for line in joins[:1])


def test_missing_and_detected_split_the_denominators(many_partitions):
    kos = [(f"ko{p}", f"K{k:05d}") for p in range(3) for k in range(12) if (k + p) % 3]
    held = {"S1": {1, 2, 5}, "S2": set(range(12)), None: {1}}
    accepted = [(s, f"K{k:05d}") for s, ks in held.items() for k in ks for _ in range(2)]
    asked = [("S1", "ko0"), ("S1", "ko2"), ("S2", "ko1"), ("S3", "ko0"), ("S1", "ko9")]
    frames = (many_partitions.createDataFrame(asked, "sample_id string, pathway_id string"), many_partitions.createDataFrame(accepted, "sample_id string, ko_id string"),
              many_partitions.createDataFrame(kos, "pathway_id string, ko_id string"))
    has = {(s, f"K{k:05d}") for s, ks in held.items() for k in ks}
    pairs = [(s, p, k) for s, p in asked for q, k in kos if p == q]
    columns = ("sample_id", "pathway_id", "ko_id")
    assert sorted(map(tuple, V.missing_kos(*frames).select(*columns).collect())) == sorted(x for x in pairs if (x[0], x[2]) not in has)
    assert sorted(map(tuple, V.detected_kos(*frames).select(*columns).collect())) == sorted(x for x in pairs if (x[0], x[2]) in has)
