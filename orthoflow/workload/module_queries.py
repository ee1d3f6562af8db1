"""Module definitions, references, completion and missing alternatives."""

from __future__ import annotations

from pyspark.sql import functions as F

from orthoflow.operators import compare as C
from orthoflow.operators import modules as M
from orthoflow.workload.registry import query
from orthoflow.workload.views import Inputs, digits, ko, union


def parsed_of(data: Inputs):
    return M.parsed_definitions(data.view("v_modules"))


def evaluated(data: Inputs, key: str = "sample_id", accepted=None):
    requests = data.view("v_module_requests" if key == "sample_id" else "v_set_module_requests").join(
        data.view("v_modules").select("module_id", "module_name"), "module_id")
    return requests, M.evaluate(requests, data.view("v_modules"), accepted or data.accepted(key), key)


_KINDS = """
SELECT module_id, nodes, refs, kos, blocks, optional, invalid FROM (SELECT module_id, n, CASE n % 10 WHEN 0 THEN 5 WHEN 1 THEN 7 WHEN 2 THEN 2 WHEN 3 THEN 4 WHEN 4 THEN 5 WHEN 5 THEN 2 WHEN 6 THEN 3 WHEN 7 THEN 0 WHEN 8 THEN 5 ELSE 12 END AS nodes,
 CASE WHEN n % 10 IN (2, 4, 5, 8) THEN 1 ELSE 0 END AS refs, CASE n % 10 WHEN 0 THEN 3 WHEN 1 THEN 4 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 2 WHEN 5 THEN 1 WHEN 6 THEN 2 WHEN 7 THEN 0 WHEN 8 THEN 2 ELSE 6 END AS kos,
 CASE n % 10 WHEN 3 THEN 1 WHEN 6 THEN 3 WHEN 7 THEN 0 ELSE 2 END AS blocks, CASE WHEN n % 10 IN (0, 9) THEN 1 ELSE 0 END AS optional, n % 10 = 7 AS invalid FROM v_modules) AS t"""


@query("module_nodes", f"SELECT module_id, nodes, refs, kos, blocks, optional FROM v_kinds WHERE NOT invalid", {"v_kinds": _KINDS})
def module_nodes(spark, sf):
    nodes = M.module_nodes(parsed_of(Inputs(spark, sf)))
    count = lambda condition: F.count_if(condition).cast("int")
    return nodes.groupBy("module_id").agg(
        F.count("*").cast("int").alias("nodes"), count(F.col("kind") == "module_reference").alias("refs"), count(F.col("kind") == "ko").alias("kos"),
        count(F.col("level") == 1).alias("blocks"), count(F.col("kind") == "optional").alias("optional"))


@query("module_diagnostics", """
SELECT module_id, CASE n % 10 WHEN 6 THEN 'UNSUPPORTED_TOKEN' ELSE 'UNMATCHED_LEFT_PARENTHESIS' END AS code, CASE n % 10 WHEN 6 THEN 'warning' ELSE 'error' END AS severity, 7 AS start, CASE n % 10 WHEN 6 THEN 'weird' ELSE '(' END AS token FROM v_modules WHERE n % 10 IN (6, 7)""")
def module_diagnostics(spark, sf):
    return M.module_diagnostics(parsed_of(Inputs(spark, sf)))


def _k(offset: int) -> str:
    return ko(f"n * 31 + {offset}")


@query("module_components", f"""
SELECT module_id, CASE n % 10 WHEN 0 THEN {_k(0)} || '-' || {_k(1)} || '|' || {_k(4)} WHEN 1 THEN {_k(4)} || '|(' || {_k(5)} || ',' || {_k(6)} || ')+' || {_k(7)} WHEN 2 THEN 'M' || {digits('n + 1')} || '|' || {_k(4)}
   WHEN 3 THEN definition WHEN 4 THEN '(M' || {digits('n - 1')} || ',' || {_k(8)} || ')|' || {_k(9)} WHEN 5 THEN module_id || '|' || {_k(4)} WHEN 6 THEN {_k(4)} || '|weird|' || {_k(5)}
   WHEN 8 THEN '(M' || {digits('n + 900')} || ',' || {_k(4)} || ')|' || {_k(5)} ELSE {_k(4)} || '+' || {_k(5)} || ',' || {_k(6)} || '|' || {_k(7)} || '-(' || {_k(8)} || ' ' || {_k(9)} || ')' END AS required_blocks,
  CASE n % 10 WHEN 0 THEN '-' || {_k(1)} WHEN 9 THEN '-(' || {_k(8)} || ' ' || {_k(9)} || ')' ELSE '' END AS optional_parts,
  CASE n % 10 WHEN 2 THEN 'M' || {digits('n + 1')} WHEN 4 THEN 'M' || {digits('n - 1')} WHEN 5 THEN module_id WHEN 8 THEN 'M' || {digits('n + 900')} ELSE '' END AS referenced_modules
FROM v_modules WHERE n % 10 <> 7""")
def module_components(spark, sf):
    data = Inputs(spark, sf)
    parts = M.module_components(data.view("v_modules"), M.module_nodes(parsed_of(data)))
    return parts.select("module_id", *[F.array_join(c, "|").alias(c) for c in ("required_blocks", "optional_parts", "referenced_modules")])


@query("module_tree", """
SELECT module_id, CASE n % 10 WHEN 0 THEN 3 WHEN 2 THEN 1 WHEN 5 THEN 1 WHEN 6 THEN 1 WHEN 9 THEN 5 WHEN 1 THEN 4 ELSE 3 END AS depth, CASE n % 10 WHEN 0 THEN 2 WHEN 9 THEN 5 ELSE 0 END AS optional_nodes, n % 10 = 6 AS has_unsupported FROM v_modules WHERE n % 10 <> 7""")
def module_tree(spark, sf):
    tree = M.module_tree(M.module_nodes(parsed_of(Inputs(spark, sf))))
    return tree.groupBy("module_id").agg(
        F.max("depth").alias("depth"), F.count_if("optional").cast("int").alias("optional_nodes"), F.bool_or("unsupported").alias("has_unsupported"))


_REFS = f"""SELECT module_id, CASE n % 10 WHEN 2 THEN 'M' || {digits('n + 1')} WHEN 4 THEN 'M' || {digits('n - 1')} WHEN 5 THEN module_id ELSE 'M' || {digits('n + 900')} END AS target_id, n FROM v_modules WHERE n % 10 IN (2, 4, 5, 8)"""


@query("module_reference_edges", "SELECT module_id, target_id FROM v_refs", {"v_refs": _REFS})
def module_reference_edges(spark, sf):
    return M.reference_edges(M.module_nodes(parsed_of(Inputs(spark, sf)))).select("module_id", "target_id")


@query("resolve_references", """
SELECT module_id AS root_id, module_id, 0 AS depth, NULL AS issue FROM v_modules UNION ALL SELECT module_id, target_id, 1, NULL FROM v_refs WHERE n % 10 IN (2, 4)
UNION ALL SELECT module_id, target_id, 1, CASE n % 10 WHEN 5 THEN 'cycle' ELSE 'unresolved' END FROM v_refs WHERE n % 10 IN (5, 8)""", {"v_refs": _REFS})
def resolve_references(spark, sf):
    data = Inputs(spark, sf)
    definitions, parsed = data.view("v_modules"), parsed_of(data)
    reachable, issues = M.resolve_references(definitions, M.reference_edges(M.module_nodes(parsed)), M.definition_validity(definitions, parsed))
    return reachable.select("root_id", "module_id", "depth", F.lit(None).cast("string").alias("issue")).unionByName(
        issues.select("root_id", F.col("target_id").alias("module_id"), (F.size("path") - 1).alias("depth"), "issue"))


# --- evaluation: truth of every template restated in SQL ------------------------------------------

def _flags(accepted: str, key: str) -> str:
    names = [f"({key} || {ko(f'n * 31 + {i}')}) IN (SELECT {key} || ko_id FROM {accepted}) AS a{i}" for i in (0, 1, 4, 5, 6, 7, 8, 9)]
    names += [f"({key} || {ko(f'(n + {d}) * 31 + {i}')}) IN (SELECT {key} || ko_id FROM {accepted}) AS {p}{i}" for d, p in ((1, "u"), (-1, "d")) for i in (5, 6)]
    return ", ".join(names)


def _truth(accepted: str, requests: str, key: str) -> str:
    t = lambda c: f"CASE WHEN {c} THEN 2 ELSE 0 END"
    return f"""
SELECT {key}, module_id, module_name, n, a0, a1, a4, a5, a6, a7, a8, a9, u5, u6, d5, d6, CASE n % 10 WHEN 0 THEN [{t('a0')}, {t('a4')}] WHEN 1 THEN [{t('a4')}, {t('(a5 OR a6) AND a7')}] WHEN 2 THEN [{t('u5 OR u6')}, {t('a4')}] WHEN 3 THEN [{t('a5 OR a6')}]
  WHEN 4 THEN [{t('d5 OR d6 OR a8')}, {t('a9')}] WHEN 5 THEN [1, {t('a4')}] WHEN 6 THEN [1, 1, 1] WHEN 7 THEN []::INTEGER[] WHEN 8 THEN [CASE WHEN a4 THEN 2 ELSE 1 END, {t('a5')}] ELSE [{t('(a4 AND a5) OR a6')}, {t('a7')}] END AS truth
FROM (SELECT {key}, module_id, module_name, n, {_flags(accepted, key)} FROM {requests} JOIN v_modules USING (module_id)) AS f"""


def _completion(key: str, source: str) -> str:
    return f"""
SELECT {key}, module_id, module_name, len(truth) AS required_block_count, len(list_filter(truth, lambda x: x = 2)) AS completed_required_blocks, len(list_filter(truth, lambda x: x <> 1)) AS evaluable_required_blocks,
  CASE WHEN len(truth) = 0 OR len(list_filter(truth, lambda x: x <> 1)) = 0 THEN 'not_evaluable' WHEN list_contains(truth, 1) THEN 'partially_evaluable' WHEN list_min(truth) = 2 THEN 'complete' ELSE 'incomplete' END AS module_status,
  CASE WHEN len(truth) = 0 OR list_contains(truth, 1) THEN NULL ELSE list_min(truth) = 2 END AS is_complete,
  CASE WHEN len(truth) > 0 AND NOT list_contains(truth, 1) THEN len(list_filter(truth, lambda x: x = 2)) / len(truth) END AS block_coverage FROM {source}"""


_EVAL = {"v_truth": _truth("v_accepted", "v_module_requests", "sample_id"), "v_set_truth": _truth("v_accepted_sets", "v_set_module_requests", "dataset_id"),
         "v_completion": _completion("sample_id", "v_truth"), "v_set_completion": _completion("dataset_id", "v_set_truth")}
COMPLETION = ("module_id", "module_name", "required_block_count", "completed_required_blocks", "evaluable_required_blocks", "module_status", "is_complete", "block_coverage")


_LEAVES = {0: "014", 1: "4567", 2: "4", 3: "56", 4: "89", 5: "4", 6: "45", 7: "", 8: "45", 9: "456789"}
_PRESENT = "CASE n % 10 " + " ".join(f"WHEN {t} THEN " + (" + ".join(f"CAST(a{d} AS INT)" for d in ds) or "0") for t, ds in _LEAVES.items()) + " END"
_LEAF_KOS = "CASE n % 10 " + " ".join(f"WHEN {t} THEN {len(ds)}" for t, ds in _LEAVES.items()) + " END"


@query("leaf_truth", f"""
SELECT sample_id, CAST(sum({_PRESENT}) AS BIGINT) AS present, CAST(sum({_LEAF_KOS}) - sum({_PRESENT}) AS BIGINT) AS absent, CAST(sum(CASE WHEN n % 10 IN (2, 4, 5, 6, 8) THEN 1 ELSE 0 END) AS BIGINT) AS unknown FROM v_truth GROUP BY 1""", _EVAL)
def leaf_truth(spark, sf):
    data = Inputs(spark, sf)
    requests = data.view("v_module_requests")
    leaves = M.leaf_truth(M.module_nodes(parsed_of(data)), requests, data.accepted())
    count = lambda truth: F.count_if(F.col("truth") == truth)
    return leaves.groupBy("sample_id").agg(count(M.TRUE).alias("present"), count(M.FALSE).alias("absent"), count(M.UNKNOWN).alias("unknown"))


@query("module_completion", "SELECT * FROM v_completion", _EVAL)
def module_completion(spark, sf):
    requests, result = evaluated(Inputs(spark, sf))
    return M.module_completion(requests, result["blocks"]).select("sample_id", *COMPLETION)


@query("batch_modules", "SELECT dataset_id, module_id, module_status, completed_required_blocks, block_coverage FROM v_set_completion", _EVAL)
def batch_modules(spark, sf):
    requests, result = evaluated(Inputs(spark, sf), "dataset_id")
    return M.module_completion(requests, result["blocks"], "dataset_id").select("dataset_id", "module_id", "module_status", "completed_required_blocks", "block_coverage")


@query("fold_truth", """
SELECT sample_id, module_id, unnest(t) AS truth, generate_subscripts(t, 1) AS block_index FROM (SELECT sample_id, module_id, CASE n % 10 WHEN 2 THEN [1, CASE WHEN a4 THEN 2 ELSE 0 END]
  WHEN 4 THEN [CASE WHEN a8 THEN 2 ELSE 1 END, CASE WHEN a9 THEN 2 ELSE 0 END] WHEN 6 THEN [CASE WHEN a4 THEN 2 ELSE 0 END, 1, CASE WHEN a5 THEN 2 ELSE 0 END] ELSE truth END AS t FROM v_truth) AS f""", _EVAL)
def fold_truth(spark, sf):
    """The fold alone: references and unsupported leaves stay unknown."""
    data = Inputs(spark, sf)
    nodes = M.module_nodes(parsed_of(data))
    alone = nodes.select("module_id").distinct().withColumn("root_id", F.col("module_id"))
    unknown = M.reference_edges(nodes).withColumn("root_id", F.col("module_id"))
    truths = M.node_truth(data.view("v_module_requests"), M.compiled(nodes, alone, unknown), data.accepted())
    return M.folded_blocks(truths).select("sample_id", F.col("root_id").alias("module_id"), "truth", F.col("block_index").cast("bigint").alias("block_index"))


@query("reference_truth", "SELECT sample_id, module_id, truth[1] AS truth FROM v_truth WHERE n % 10 IN (2, 4, 5, 8)", _EVAL)
def reference_truth(spark, sf):
    """Blocks that hold a reference to another module."""
    data = Inputs(spark, sf)
    _, result = evaluated(data)
    referring = result["nodes"].filter("kind = 'module_reference'").select("module_id", "block_index")
    return result["blocks"].join(referring, ["module_id", "block_index"], "left_semi").select("sample_id", "module_id", "truth")


@query("block_states", """
SELECT sample_id, module_id, CAST(generate_subscripts(truth, 1) AS INTEGER) AS block_index, CASE unnest(truth) WHEN 2 THEN 'complete' WHEN 0 THEN 'incomplete' ELSE 'not_evaluable' END AS state FROM v_truth""", _EVAL)
def block_states(spark, sf):
    _, result = evaluated(Inputs(spark, sf))
    return result["blocks"].select("sample_id", "module_id", "block_index", "state")


_OPT = """
SELECT sample_id, module_id, CASE WHEN n % 10 = 0 THEN CASE WHEN a1 THEN 'present' ELSE 'absent' END WHEN a8 AND a9 THEN 'present' WHEN a8 OR a9 THEN 'partially_present' ELSE 'absent' END AS state FROM v_truth WHERE n % 10 IN (0, 9)"""


@query("optional_states", _OPT, _EVAL)
def optional_states(spark, sf):
    _, result = evaluated(Inputs(spark, sf))
    return result["optional"].select("sample_id", "module_id", "state")


def _member(flag: str) -> str:
    """KO text behind a flag: ``a`` of the module itself, ``u`` of the next one, ``d`` of the one before."""
    shift = {"a": "n", "u": "(n + 1)", "d": "(n - 1)"}[flag[0]]
    return ko(f"{shift} * 31 + {flag[1]}")


_BLOCK_MEMBERS = {0: ("a0", "a4"), 1: ("a4", "a5 a6 a7"), 2: ("u5 u6", "a4"), 3: ("a5 a6",), 4: ("d5 d6 a8", "a9"), 5: ("", "a4"), 6: ("", "", ""), 8: ("a4", "a5"), 9: ("a4 a5 a6", "a7")}
_MATCHED = " UNION ALL ".join(
    f"SELECT sample_id, module_id, {i} AS block_index, " + (
        "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {f} THEN {_member(f)} END" for f in flags.split()) + "], lambda x: x IS NOT NULL), ';')" if flags else "''")
    + f" AS matched FROM v_truth WHERE n % 10 = {t}" for t, blocks in _BLOCK_MEMBERS.items() for i, flags in enumerate(blocks, 1))


@query("matched_kos", _MATCHED, _EVAL)
def matched_kos(spark, sf):
    """KOs found in each block, also inside referenced modules; optional parts do not count."""
    _, result = evaluated(Inputs(spark, sf))
    return result["blocks"].select("sample_id", "module_id", "block_index", F.array_join("matched", ";").alias("matched"))


@query("required_component_count", """
SELECT sample_id, module_id, CAST(CASE n % 10 WHEN 0 THEN 2 WHEN 1 THEN 4 WHEN 2 THEN 3 WHEN 3 THEN 2 WHEN 4 THEN 4 WHEN 5 THEN 2 WHEN 6 THEN 3 WHEN 8 THEN 3 ELSE 4 END AS BIGINT) AS required FROM v_truth WHERE n % 10 <> 7""", _EVAL)
def required_component_count(spark, sf):
    _, result = evaluated(Inputs(spark, sf))
    return result["blocks"].groupBy("sample_id", "module_id").agg(F.sum("required").alias("required"))


_ONE_OF = {(0, 1): "a0", (0, 2): "a4", (1, 1): "a4", (2, 1): "u5 u6", (2, 2): "a4", (3, 1): "a5 a6", (4, 1): "d5 d6 a8", (4, 2): "a9", (5, 2): "a4", (8, 2): "a5", (9, 2): "a7"}
_MISSING = " UNION ALL ".join(
    f"SELECT sample_id, module_id, {i} AS block_index, " + " || '|' || ".join(_member(f) for f in flags.split()) + f" AS alternatives, false AS truncated FROM v_truth WHERE n % 10 = {t} AND truth[{i}] = 0"
    for (t, i), flags in _ONE_OF.items())


@query("missing_alternatives", _MISSING + f"""
UNION ALL SELECT sample_id, module_id, 2, CASE WHEN NOT (a5 OR a6) AND NOT a7 THEN {_k(5)} || '+' || {_k(7)} || '|' || {_k(6)} || '+' || {_k(7)} WHEN NOT a7 THEN {_k(7)} ELSE {_k(5)} || '|' || {_k(6)} END, false FROM v_truth WHERE n % 10 = 1 AND truth[2] = 0
UNION ALL SELECT sample_id, module_id, 1, CASE WHEN NOT a4 AND NOT a5 THEN {_k(6)} || '|' || {_k(4)} || '+' || {_k(5)} WHEN a4 THEN {_k(5)} || '|' || {_k(6)} ELSE {_k(4)} || '|' || {_k(6)} END, false FROM v_truth WHERE n % 10 = 9 AND truth[1] = 0""", _EVAL)
def missing_alternatives(spark, sf):
    """Every incomplete block of every requested module."""
    _, result = evaluated(Inputs(spark, sf))
    rows = M.missing_alternatives(result["blocks"], 64)
    return rows.withColumn("alternatives", F.array_join(F.transform("alternatives", lambda a: F.array_join(a, "+")), "|"))


@query("module_warnings", """
SELECT sample_id, module_id, CASE n % 10 WHEN 5 THEN 'REFERENCE_CYCLE;PARTIAL_EVALUATION' WHEN 6 THEN 'UNSUPPORTED_CONTENT' WHEN 7 THEN 'UNSUPPORTED_CONTENT' WHEN 8 THEN CASE WHEN a4 THEN 'UNRESOLVED_REFERENCE' ELSE 'UNRESOLVED_REFERENCE;PARTIAL_EVALUATION' END ELSE '' END AS warnings FROM v_truth""", _EVAL)
def module_warnings(spark, sf):
    requests, result = evaluated(Inputs(spark, sf))
    completion = M.module_completion(requests, result["blocks"])
    cut = M.missing_alternatives(result["blocks"], 64)
    return M.module_warnings(completion, result["blocks"], result["issues"], result["facts"], cut).withColumn("warnings", F.array_join("warnings", ";"))


_COMPARED = """
SELECT module_id, count(*) AS compared_inputs, count(DISTINCT module_status || completed_required_blocks || ':' || evaluable_required_blocks) > 1 AS outcomes_differ,
  coalesce(string_agg(CAST(input_index AS VARCHAR), ';' ORDER BY input_index) FILTER (WHERE module_status = 'complete'), '') AS complete_in, coalesce(string_agg(CAST(input_index AS VARCHAR), ';' ORDER BY input_index) FILTER (WHERE module_status = 'incomplete'), '') AS incomplete_in,
  coalesce(string_agg(CAST(input_index AS VARCHAR), ';' ORDER BY input_index) FILTER (WHERE module_status = 'partially_evaluable'), '') AS partially_evaluable_in, coalesce(string_agg(CAST(input_index AS VARCHAR), ';' ORDER BY input_index) FILTER (WHERE module_status = 'not_evaluable'), '') AS not_evaluable_in
FROM v_set_completion JOIN v_datasets USING (dataset_id) GROUP BY 1"""


@query("compare_modules", _COMPARED, _EVAL)
def compare_modules(spark, sf):
    data = Inputs(spark, sf)
    requests, result = evaluated(data, "dataset_id")
    outcomes = M.module_completion(requests, result["blocks"], "dataset_id").join(data.view("v_datasets").select("dataset_id", "input_index"), "dataset_id")
    return C.compare_outcomes(outcomes, "module_id", ("module_status", "completed_required_blocks", "evaluable_required_blocks", "block_coverage"), "module_status")


@query("write_module_completion", """
SELECT sample_id, module_id, module_name, module_status AS evaluation_status, coalesce(CAST(is_complete AS VARCHAR), '') AS exact_completion, coalesce(CAST(block_coverage AS VARCHAR), '') AS block_coverage, CAST(completed_required_blocks AS VARCHAR) AS completed_required_blocks,
  CAST(evaluable_required_blocks AS VARCHAR) AS evaluable_required_blocks, CAST(required_block_count AS VARCHAR) AS required_block_count FROM v_completion""", _EVAL)
def write_module_completion(spark, sf):
    from orthoflow.sinks.tables import module_completion_table

    requests, result = evaluated(Inputs(spark, sf))
    return module_completion_table(M.module_completion(requests, result["blocks"]), "sample_id")
