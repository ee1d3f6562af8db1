"""Snapshot differences by digests against a plain comparison, and scopes."""

from __future__ import annotations

import random

import pytest

from orthoflow.operators import snapshots as D

SCHEMA = "database string, identifier string, field string, items array<string>"


def plain(left, right):
    l, r = ({(d, i): {} for d, i, _, _ in side} for side in (left, right))
    for side, found in ((left, l), (right, r)):
        for d, i, f, items in side:
            found[d, i][f] = items
    out = {(*k, None, "entry_removed") for k in l.keys() - r.keys()} | {(*k, None, "entry_added") for k in r.keys() - l.keys()}
    for k in l.keys() & r.keys():
        for f in l[k].keys() | r[k].keys():
            if k[0] == "module" and f == "definition" or l[k].get(f) == r[k].get(f):
                continue
            out.add((*k, f, "field_added" if l[k].get(f) is None else "field_removed" if r[k].get(f) is None else "field_modified"))
    return out


def side(rng, n=150):
    rows = []
    for k in range(n):
        if rng.random() < 0.1:
            continue
        for field in ("modules", "definition", "ko_identifiers", "name"):
            if rng.random() < 0.9:
                rows.append((["module", "ko", "pathway"][k % 3], f"E{k}", field, [f"x{rng.randint(0, 2)}"] * rng.randint(0, 2) if rng.random() < 0.2 else [field]))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_diff_equals_a_plain_comparison(spark, seed):
    rng = random.Random(seed)
    left, right = side(rng), side(rng)
    l, r = (spark.createDataFrame(x, SCHEMA) for x in (left, right))
    found = {(x["database"], x["identifier"], x["field"], x["change_type"]) for x in D.snapshot_diff(l, r).collect()}
    assert found == plain(left, right)
    assert D.snapshot_diff(l, l.orderBy("field")).count() == 0
    only = D.snapshot_diff(l, r, parser_compatible=False).collect()
    assert {x["change_type"] for x in only} <= {"entry_added", "entry_removed"} and len(only) == len({x for x in plain(left, right) if x[2] is None})
    assert D.snapshot_diff(l.limit(0), r.limit(0)).count() == 0


def test_digests_tell_swapped_items_apart(spark):
    left = [("ko", "E1", "modules", ["a"]), ("ko", "E1", "name", ["b"]), ("ko", "E2", "modules", None), ("ko", "E3", "modules", ["a", None])]
    right = [("ko", "E1", "modules", ["b"]), ("ko", "E1", "name", ["a"]), ("ko", "E2", "modules", []), ("ko", "E3", "modules", ["a"])]
    rows = D.snapshot_diff(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)).collect()
    assert sorted((r["identifier"], r["field"], r["change_type"], r["added"], r["removed"]) for r in rows) == [
        ("E1", "modules", "field_modified", ["b"], ["a"]), ("E1", "name", "field_modified", ["a"], ["b"]), ("E2", "modules", "field_added", [], []),
        ("E3", "modules", "field_modified", [], [None])]


def test_snapshots_of_different_scopes_are_refused(spark):
    frame = spark.createDataFrame([("ko", "E1", "name", ["b"])], SCHEMA)
    scope = spark.createDataFrame([("ko", f"E{k}") for k in range(4)], "database string, identifier string")
    assert D.snapshot_diff(frame, frame, scopes=(scope, scope.orderBy("identifier"))).count() == 0
    with pytest.raises(ValueError, match="4 and 3"):
        D.snapshot_diff(frame, frame, scopes=(scope, scope.filter("identifier <> 'E2'")))
