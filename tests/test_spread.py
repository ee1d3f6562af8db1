"""KO sets beside tables about KOs: pairs stay in the task that holds the set, and the results are those of plain loops."""

from __future__ import annotations

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from orthoflow.operators import coverage as V
from orthoflow.operators import relations as R
from orthoflow.sources import mapxml as G
from orthoflow.workload import ORACLES, QUERIES
from orthoflow.workload.views import TABLES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ("rank_pathways", "rank_modules", "target_overlap", "detected_kos", "missing_kos"))
def test_pairs_are_not_shuffled(spark, name):
    """The last join of the pairs has no exchange above it."""
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and plan.index("ShuffledHashJoin") < plan.index("Exchange ")


@pytest.fixture(scope="module")
def sets():
    draw = random.Random(5)
    return {f"S{n}": {f"K{draw.randrange(40):05d}" for _ in range(draw.choice((0, 1, 5, 30)))} for n in range(60)} | {None: {"K00001"}}


def accepted_of(spark, sets):
    return spark.createDataFrame([(s, k) for s, kos in sets.items() for k in kos], "sample_id string, ko_id string")


def test_lists_and_ranks_over_small_batches(spark, sets):
    draw = random.Random(6)
    edges = [(f"K{k:05d}", f"T{draw.randrange(9)}", rows) for k in range(35) for rows in (1, 2)]
    normalized = spark.createDataFrame([(k, t) for k, t, rows in edges for _ in range(rows)], "ko_id string, target_id string")
    wanted = {}
    for sample, kos in sets.items():
        mine = {}
        for k, t, rows in edges:
            if k in kos:
                held = mine.setdefault(t, [set(), 0])
                held[0].add(k)
                held[1] += rows
        for rank, (t, (found, rows)) in enumerate(sorted(mine.items(), key=lambda item: (-len(item[1][0]), item[0])), 1):
            wanted[sample, t] = (len(found), tuple(sorted(found)), rows, rank)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = R.ranked_overlap(accepted_of(spark, sets), normalized).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r["sample_id"], r["target_id"]): (r["detected_kos"], tuple(r["ko_ids"]), r["relation_rows"], r["rank"]) for r in rows} == wanted
    assert len(rows) == len(wanted)


def test_previews_are_cut_lists(spark, sets):
    kos = [(f"ko{p}", f"K{k:05d}") for p in range(5) for k in range(40) if (k + p) % 3]
    asked = [(s, f"ko{p}") for s in sets if s is not None for p in range(4)]
    rows = V.previews(spark.createDataFrame(asked, "sample_id string, pathway_id string"), accepted_of(spark, sets),
                      spark.createDataFrame(kos, "pathway_id string, ko_id string"), 2).collect()
    wanted = {}
    for s, p in asked:
        found = sorted(k for q, k in kos if q == p and k in sets[s])
        if found:
            wanted[s, p] = (tuple(found[:2]), len(found), len(found) > 2)
    assert {(r["sample_id"], r["pathway_id"]): (tuple(r["preview"]), r["n"], r["truncated"]) for r in rows} == wanted


def test_overlay_counts_equal_overlay_rows(spark, sets):
    draw = random.Random(7)
    shapes = spark.createDataFrame(
        [(f"ko{n % 4}", n % 50, draw.choice(("box", "polyline")), sorted({f"K{draw.randrange(40):05d}" for _ in range(draw.randrange(1, 5))}),
          "invalid_size" if n % 11 == 0 else None) for n in range(120)], "pathway_id string, entry_id int, kind string, ko_ids array<string>, fault string")
    accepted = accepted_of(spark, sets).filter("sample_id is not null")
    rows = G.overlay(shapes, accepted).groupBy("sample_id", "pathway_id", "kind").agg(F.count("*").alias("shapes"), F.sum(F.size("accepted_kos")).alias("ko_links"))
    columns = ("sample_id", "pathway_id", "kind", "shapes", "ko_links")
    assert sorted(map(tuple, G.overlay_counts(shapes, accepted).select(*columns).collect())) == sorted(map(tuple, rows.select(*columns).collect()))


def test_overlay_covers_all_maps(spark):
    """Every map that shows an accepted KO of a sample, not only chosen ones."""
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    theirs = con.sql(f"SELECT sample_id, pathway_id, kind, shapes, ko_links FROM ({ORACLES['overlay_graphics']}) AS t").fetchall()
    ours = QUERIES["overlay_graphics"](spark, FOLDER).select("sample_id", "pathway_id", "kind", "shapes", "ko_links").collect()
    assert sorted(map(tuple, ours)) == sorted(theirs)
    assert max(sum(1 for pair in {(r[0], r[1]) for r in theirs} if pair[0] == sample) for sample in {r[0] for r in theirs}) > 3
