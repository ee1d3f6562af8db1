"""Compiled module logic and streamed minimal sets."""

from __future__ import annotations

import itertools
import random

import pytest

from orthoflow.functions.programs import ALL_OF, ONE_OF, Alternatives, TooMany, antichain, bits_of
from orthoflow.operators import modules as M


def alternatives(levels, truth, n, cap=None):
    found = Alternatives(n, levels, truth, cap)
    found.check(n + 1 + sum(map(len, levels)))
    return found


def and_of_ors(factors):
    """Levels of an "all of" over "one of" factors of leaves, all absent."""
    n = 1 + max(k for f in factors for k in f)
    levels = [[{"op": ONE_OF, "kids": list(f)} for f in factors], [{"op": ALL_OF, "kids": list(range(n + 2, n + 2 + len(factors)))}]]
    return levels, [0] * n + [1, 2] + [0] * (len(factors) + 1), n


def brute(factors, n):
    sets = [c for size in range(n + 1) for c in itertools.combinations(range(n), size) if all(set(f) & set(c) for f in factors)]
    return {frozenset(c) for c in sets if not any(set(o) < set(c) for o in sets)}


@pytest.mark.parametrize("seed", range(12))
def test_hitting_sets_match_brute_force(seed):
    rng = random.Random(seed)
    n = rng.randint(3, 8)
    factors = [rng.sample(range(n), rng.randint(1, 3)) for _ in range(rng.randint(2, 5))] + [[n - 1]]
    levels, truth, n = and_of_ors(factors)
    found = alternatives(levels, truth, n)
    top = n + 1 + sum(map(len, levels))
    assert {frozenset(bits_of(m)) for m in found.minimal(top)} == brute(factors, n)
    # The same through the stream alone, cut into three walks.
    found.lists = {k: v for k, v in found.lists.items() if k < n or len(v) <= 3 and k != top}
    parts = [{frozenset(bits_of(m)) for m in found.minimal(top, shard, 3)} for shard in range(3)]
    assert set().union(*parts) == brute(factors, n)


def test_a_large_product_streams():
    """Twelve factors of three: 531,441 sets, walked without a list of them."""
    factors = [[3 * k, 3 * k + 1, 3 * k + 2] for k in range(12)]
    levels, truth, n = and_of_ors(factors)
    found = alternatives(levels, truth, n)
    top = n + 1 + sum(map(len, levels))
    assert top not in found.lists and found.bounds[top] == 3 ** 12
    shards = found.shards(top, 100_000)
    assert shards == 5
    counts = [sum(1 for _ in found.minimal(top, s, shards)) for s in range(shards)]
    assert sum(counts) == 3 ** 12 and max(counts) < 2 * 3 ** 12 / shards
    first = list(itertools.islice(found.minimal(top), 5))
    assert len(set(first)) == 5 and all(m.bit_count() == 12 for m in first)
    with pytest.raises(TooMany):
        alternatives(levels, truth, n, cap=10_000)


def test_antichain_keeps_the_smallest():
    assert antichain([7, 3, 3, 8, 12]) == [8, 3]


def test_large_block_as_rows_and_bounded(spark):
    text = "+".join(f"(K{k:05d},K{k + 100:05d},K{k + 200:05d})" for k in range(10))
    definitions = spark.createDataFrame([("M00001", text), ("M00002", "(K00001,K00002)+(K00002,K00003)")], "module_id string, definition string")
    requests = spark.createDataFrame([("s", "M00001"), ("s", "M00002")], "sample_id string, module_id string")
    accepted = spark.createDataFrame([("s", "K00000")], "sample_id string, ko_id string")
    blocks = M.evaluate(requests, definitions, accepted)["blocks"]
    rows = M.missing_rows(blocks, shard_rows=1_000)
    counts = {r["module_id"]: r["count"] for r in rows.groupBy("module_id").count().collect()}
    assert counts == {"M00001": 3 ** 9, "M00002": 2}
    closed = {r["module_id"]: (r["alternatives"], r["truncated"]) for r in M.missing_alternatives(blocks, 64, cap=10_000).collect()}
    assert closed == {"M00001": ([], True), "M00002": ([["K00002"], ["K00001", "K00003"]], False)}
    cut = {r["module_id"]: r for r in M.missing_alternatives(blocks, 64).collect()}
    assert len(cut["M00001"].alternatives) == 64 and cut["M00001"].truncated and len(set(map(tuple, cut["M00001"].alternatives))) == 64


def test_wide_and_deep_definitions(spark):
    deep = "(" * 300 + "K00001" + "".join(f",K{k:05d})+K{k + 500:05d}" if k % 2 else f",K{k:05d})" for k in range(2, 302))
    wide = "+".join(f"K{k:05d}" for k in range(3000))
    definitions = spark.createDataFrame([("M00001", deep), ("M00002", wide), ("M00003", "M00001 M00002"), ("M00004", "M00004 K00001"), ("M00005", "(K00001"),
                                         ("M00006", "M00007 K00009"), ("M00007", "-K00001")], "module_id string, definition string")
    requests = spark.createDataFrame([("s", f"M0000{k}") for k in range(1, 8)] + [("none", "M00001")], "sample_id string, module_id string")
    accepted = spark.createDataFrame([("s", f"K{k:05d}") for k in [*range(3000), 99999]], "sample_id string, ko_id string")
    result = M.evaluate(requests, definitions, accepted)
    states = {(r.sample_id, r.module_id): r.module_status for r in M.module_completion(requests, result["blocks"]).collect()}
    assert states == {("s", "M00001"): "complete", ("s", "M00002"): "complete", ("s", "M00003"): "complete", ("s", "M00004"): "partially_evaluable",
                      ("s", "M00005"): "not_evaluable", ("s", "M00006"): "partially_evaluable", ("s", "M00007"): "not_evaluable", ("none", "M00001"): "incomplete"}


def test_sets_that_found_the_same_kos_share_one_walk(spark, monkeypatch):
    """300 sets, of three cases each with its own answer, are walked as three; a request made twice is one row."""
    walked, rows = [], M.missing_rows

    def counted(blocks, *args, **kwargs):
        walked.append(blocks.count())
        return rows(blocks, *args, **kwargs)

    monkeypatch.setattr(M, "missing_rows", counted)
    definitions = spark.createDataFrame([("M00001", "(K00001,K00002)+K00003 K00009")], "module_id string, definition string")
    requests = spark.createDataFrame([(f"s{k}", "M00001") for k in range(300)] + [("s0", "M00001")], "sample_id string, module_id string")
    own = {0: ["K00009"], 1: ["K00001", "K00009"], 2: ["K00003", "K00009"]}
    accepted = spark.createDataFrame([(f"s{k}", ko) for k in range(300) for ko in own[k % 3]], "sample_id string, ko_id string")
    found = M.missing_alternatives(M.evaluate(requests, definitions, accepted)["blocks"], 64).collect()
    answers = {0: [["K00001", "K00003"], ["K00002", "K00003"]], 1: [["K00003"]], 2: [["K00001"], ["K00002"]]}
    assert walked == [3] and len(found) == 300
    assert all(r.alternatives == answers[int(r.sample_id[1:]) % 3] and not r.truncated and r.block_index == 1 for r in found)
