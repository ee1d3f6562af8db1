from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from orthoflow.functions.definitions import Limits, definition_rows
from orthoflow.operators import modules as M


LIMITS = Limits(bytes=65_536, tokens=4_096, nodes=4_096, nesting=64)


def evaluate(spark, definitions, accepted, limit=64):
    defs = spark.createDataFrame(list(definitions.items()), "module_id string, definition string")
    requests = spark.createDataFrame([("s", next(iter(definitions)))], "sample_id string, module_id string")
    kos = spark.createDataFrame([("s", k) for k in accepted], "sample_id string, ko_id string")
    result = M.evaluate(requests, defs, kos)
    row = M.module_completion(requests, result["blocks"]).first()
    alternatives = M.missing_alternatives(result["blocks"], limit)
    missing = alternatives.collect()
    optional = [r.state for r in result["optional"].collect()]
    warnings = M.module_warnings(M.module_completion(requests, result["blocks"]), result["blocks"], result["issues"], result["facts"], alternatives).first().warnings
    return row, missing, optional, warnings


def test_optional_part_is_neutral(spark):
    row, _, optional, _ = evaluate(spark, {"M00001": "K00001-K00002 K00003"}, ["K00001", "K00003"])
    assert (row.module_status, row.required_block_count, row.block_coverage, optional) == ("complete", 2, 1.0, ["absent"])


def test_nested_references(spark):
    row, _, _, _ = evaluate(spark, {"M00001": "M00002 K00004", "M00002": "M00003+K00003", "M00003": "(K00001,K00002)"}, ["K00002", "K00003", "K00004"])
    assert row.module_status == "complete" and row.completed_required_blocks == 2


def test_unresolved_reference_beside_a_true_alternative(spark):
    row, _, _, warnings = evaluate(spark, {"M00001": "(M00002,K00001) K00003"}, ["K00001", "K00003"])
    assert row.module_status == "complete" and warnings == ["UNRESOLVED_REFERENCE"]


def test_missing_sets_are_cut_at_the_limit(spark):
    _, missing, _, _ = evaluate(spark, {"M00001": "(K00001,K00002)+(K00003,K00004)"}, [], limit=2)
    assert missing[0].alternatives == [["K00001", "K00003"], ["K00001", "K00004"]] and missing[0].truncated


def test_missing_sets_are_minimal(spark):
    _, missing, _, _ = evaluate(spark, {"M00001": "((K00001+K00002),K00003)+(K00001+K00002)"}, [])
    assert missing[0].alternatives == [["K00001", "K00002"]] and not missing[0].truncated


def test_false_beside_unknown_claims_nothing(spark):
    _, missing, _, _ = evaluate(spark, {"M00001": "K00001+M00002"}, [])
    assert missing[0].alternatives == [] and missing[0].truncated


def test_unsupported_content_below_the_root_blocks_all(spark):
    row, _, _, warnings = evaluate(spark, {"M00001": "(M00002,K00001) K00003", "M00002": "odd"}, ["K00001", "K00003"])
    assert row.module_status == "not_evaluable" and row.block_coverage is None and "UNSUPPORTED_CONTENT" in warnings


def test_cycles_follow_the_path_from_the_root(spark):
    row, _, _, warnings = evaluate(spark, {"M00001": "M00002 K00001", "M00002": "(M00001,K00002)"}, ["K00001", "K00002"])
    assert row.module_status == "complete" and "REFERENCE_CYCLE" in warnings


@pytest.mark.parametrize("text, code", [
    ("K00001 (K00002", "UNMATCHED_LEFT_PARENTHESIS"), ("K00001)", "UNMATCHED_RIGHT_PARENTHESIS"), ("K00001,", "MISSING_OPERAND"),
    ("()", "MISSING_OPERAND"), ("+K00001", "MISSING_OPERAND"), ("(K00001)(K00002)", "UNEXPECTED_TOKEN"), ("  ", "EMPTY_DEFINITION"),
    ("(" * 70 + "K00001" + ")" * 70, "NESTING_LIMIT_EXCEEDED"), ("K00001 " * 3000, "TOKEN_LIMIT_EXCEEDED"), ("K" * 70000, "DEFINITION_LIMIT_EXCEEDED")])
def test_diagnostics(text, code):
    assert [r["code"] for r in definition_rows("M1", text, LIMITS) if r["row_type"] == "diagnostic" and r["severity"] == "error"] == [code]


def test_spaces_around_operators_are_formatting():
    kinds = [r["kind"] for r in definition_rows("M1", "K00001 + K00002 , ( K00003  K00004 ) K00005") if r["row_type"] == "node"]
    assert kinds == ["or", "and", "ko", "ko", "group", "and", "ko", "ko", "ko"]


def random_expression(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        return ("ko", f"K0000{rng.randint(1, 6)}")
    return (rng.choice(["and", "or"]), [random_expression(rng, depth - 1) for _ in range(rng.randint(2, 3))])


def text_of(node):
    if node[0] == "ko":
        return node[1]
    return "(" + ("+" if node[0] == "and" else ",").join(text_of(c) for c in node[1]) + ")"


def holds(node, kos):
    if node[0] == "ko":
        return node[1] in kos
    return (all if node[0] == "and" else any)(holds(c, kos) for c in node[1])


def test_fold_and_missing_sets_match_brute_force(spark):
    """Every minimal completing set is found, and nothing else."""
    rng = random.Random(11)
    universe = [f"K0000{i}" for i in range(1, 7)]
    trees = {f"M0000{i}": random_expression(rng, 3) for i in range(1, 9)}
    sets = {f"s{j}": {k for k in universe if rng.random() < 0.4} for j in range(3)}
    defs = spark.createDataFrame([(m, text_of(t)) for m, t in trees.items()], "module_id string, definition string")
    requests = spark.createDataFrame(list(itertools.product(sets, trees)), "sample_id string, module_id string")
    accepted = spark.createDataFrame([(s, k) for s, kos in sets.items() for k in kos], "sample_id string, ko_id string")
    result = M.evaluate(requests, defs, accepted)
    states = {(r.sample_id, r.module_id): r.state for r in result["blocks"].collect()}
    found = {(r.sample_id, r.module_id): {frozenset(a) for a in r.alternatives} for r in M.missing_alternatives(result["blocks"], 10_000).collect()}
    for (sample, kos), (module, node) in itertools.product(sets.items(), trees.items()):
        assert states[sample, module] == ("complete" if holds(node, kos) else "incomplete")
        if not holds(node, kos):
            absent = [k for k in universe if k not in kos]
            completing = [frozenset(c) for n in range(1, 7) for c in itertools.combinations(absent, n) if holds(node, kos | set(c))]
            assert found[sample, module] == {c for c in completing if not any(o < c for o in completing)}


def test_long_definitions_have_no_limit_unless_asked_for():
    text = "+".join(f"K{k:05d}" for k in range(5000))
    rows = list(definition_rows("M00001", text))
    assert sum(r["row_type"] == "node" for r in rows) == 5001
    assert [r["code"] for r in definition_rows("M00001", text, Limits(tokens=4096))] == ["TOKEN_LIMIT_EXCEEDED"]


def test_references_deeper_than_32_are_followed(spark):
    depth = 34
    definitions = spark.createDataFrame(
        [(f"M{k:05d}", f"M{k + 1:05d}+K00001") for k in range(1, depth)] + [(f"M{depth:05d}", "K00001")], "module_id string, definition string")
    parsed = M.parsed_definitions(definitions).cache()
    nodes = M.module_nodes(parsed)
    roots = spark.createDataFrame([("M00001",)], "module_id string")
    reachable, issues = M.resolve_references(roots, M.reference_edges(nodes), M.definition_validity(definitions, parsed))
    assert reachable.agg(F.max("depth")).first()[0] == depth - 1 and issues.isEmpty()
    _, limited = M.resolve_references(roots, M.reference_edges(nodes), M.definition_validity(definitions, parsed), max_depth=3)
    assert [r.issue for r in limited.collect()] == ["depth_limit"]
