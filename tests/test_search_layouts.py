"""Postings and the mass layout give what plain searches give, and skip what they need not read."""

from __future__ import annotations

import random
import tempfile

import pytest

from orthoflow.operators import search as Q

SCHEMA = "database string, identifier string, text string, exact_mass decimal(20,4)"


def entries(spark, n=400):
    rng = random.Random(4)
    words = ["Red", "ring", "kinase", "glucose", "al", "Phosphate", "été", "x1", "transport"]
    rows = []
    for k in range(n):
        mass = None if k % 17 == 0 else f"{rng.randint(0, 300)}.{rng.randint(0, 9999):04d}"
        rows.append((rng.choice(["module", "compound", "genome"]), f"E{k}", " ".join(rng.choices(words, k=rng.randint(0, 5))), mass))
    frame = spark.createDataFrame(rows, "database string, identifier string, text string, mass string")
    return frame.selectExpr("database", "identifier", "text", "cast(mass as decimal(20,4)) as exact_mass")


def leaf_rows(frame):
    """Rows that the scan gave to the plan above it, after it skipped files and row groups."""
    frame.collect()
    leaves = frame._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().get("numOutputRows").get().value() for i in range(leaves.size()))


@pytest.fixture(scope="module")
def written(spark):
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    layout = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    old = {k: spark.conf.get(k) for k in layout}
    for k, v in layout.items():
        spark.conf.set(k, v)
    Q.write_postings(entries(spark), f"{base}/postings")
    Q.write_by_mass(entries(spark), f"{base}/masses")
    for k, v in old.items():
        spark.conf.set(k, v)
    return base


@pytest.mark.parametrize(("database", "keyword"), [("module", "red ring"), ("compound", "GLUCOSE"), ("organism", "été"), ("module", "al"), ("module", "al phos"),
                                                   ("module", "absent word"), ("compound", "ase luc"), ("module", "x1")])
def test_postings_find_what_a_scan_finds(spark, written, database, keyword):
    table = entries(spark)
    found = sorted(r["identifier"] for r in Q.search_postings(table, f"{written}/postings", database, keyword).collect())
    assert found == sorted(r["identifier"] for r in Q.search_keyword(table, database, keyword).collect())


def test_postings_of_the_rarest_grams_only(spark, written):
    rows = Q.posting_rows(spark, f"{written}/postings", "module", "kinase ring")
    grams = {r["gram"] for r in rows.collect()}
    assert len(grams) == 2 and any(g in "kinase" for g in grams) and any(g in "ring" for g in grams)
    whole = spark.read.parquet(f"{written}/postings/postings").count()
    assert leaf_rows(rows) < whole / 2
    assert Q.posting_rows(spark, f"{written}/postings", "module", "al x1") is None
    assert Q.posting_rows(spark, f"{written}/postings", "module", "zzzz").count() == 0


@pytest.mark.parametrize("query", ["100-120", "99.5-99.5", "50", "50.1", "0.5", "120.1234", "7.000000000000", "299.99999-300.5"])
def test_masses_are_found_in_the_layout(spark, written, query):
    table, layout = entries(spark), spark.read.parquet(f"{written}/masses")
    found = sorted(r["identifier"] for r in Q.search_mass(layout, "compound", query).collect())
    assert found == sorted(r["identifier"] for r in Q.search_mass(table, "compound", query).collect())
    plain = table.filter("database = 'compound' and exact_mass is not null").collect()
    from decimal import ROUND_HALF_UP, Decimal

    low, _, high = query.partition("-")
    places = Decimal(1).scaleb(-len(low.partition(".")[2]))
    fits = (lambda m: Decimal(low) <= m <= Decimal(high)) if high else (lambda m: m.quantize(places, ROUND_HALF_UP) == Decimal(low))
    assert found == sorted(r["identifier"] for r in plain if fits(r["exact_mass"]))


def test_mass_range_reaches_the_scan(spark, written, capfd):
    hits = Q.search_mass(spark.read.parquet(f"{written}/masses"), "compound", "100-120")
    hits.explain("formatted")
    plan = capfd.readouterr().out
    assert "GreaterThanOrEqual(exact_mass" in plan and "LessThanOrEqual(exact_mass" in plan
    assert leaf_rows(hits) < 400 / 2
    with pytest.raises(ValueError):
        Q.search_mass(entries(spark), "compound", "0")
