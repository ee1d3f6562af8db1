"""Module logic: node tables, references, three-valued truth, completion and missing alternatives.

Truth is 0 (false), 1 (unknown), 2 (true), so "all of" is ``min`` and "one of" is ``max``.

Definitions are compiled first: a root and all it refers to become one program of array levels. A set's
accepted KOs are a bitmap by KO number. A (set, module) is then one row whose leaf bits come from the bitmap and whose
levels are folded inside one expression, so neither nesting nor references add joins, shuffles or jobs per set.

Minimal missing sets are rows. They are walked as bit masks by a stream per block, large blocks in
several tasks, so no cell and no task holds all of them. They depend on a block and the KOs found in it alone, so
sets that found the same KOs of a block share one walk.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from orthoflow.functions.bitmaps import PIECE, bit_is_set, piece_of
from orthoflow.functions.definitions import NODE_SCHEMA, Limits, parser
from orthoflow.functions.programs import FALSE, ONE_OF, PROGRAM, TRUE, UNKNOWN, Alternatives, TooMany, bits_of, compile_root, folded
from orthoflow.functions.staging import computed
from orthoflow.session import cut_lineage, written

# Warning codes in order.
WARNING_CODES = (
    "UNSUPPORTED_CONTENT", "UNRESOLVED_REFERENCE", "REFERENCE_CYCLE", "REFERENCE_LIMIT", "PARTIAL_EVALUATION",
    "NO_REQUIRED_COMPONENT", "MISSING_ALTERNATIVES_TRUNCATED",
)
#: KO numbers have five digits.
PIECES = -(-100_000 // PIECE)
#: Candidates that one task walks through, about.
SHARD_ROWS = 100_000
_BATCH = 10_000


# --- definitions -------------------------------------------------------------------------------

def parsed_definitions(definitions: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Node and diagnostic rows of every definition; ``limits`` bounds definitions where a caller wants that."""
    return definitions.select("module_id", "definition").mapInArrow(parser(limits), NODE_SCHEMA)


def module_nodes(parsed: DataFrame) -> DataFrame:
    return parsed.filter("row_type = 'node'").drop("row_type", "code", "severity")


def module_diagnostics(parsed: DataFrame) -> DataFrame:
    return parsed.filter("row_type = 'diagnostic'").select("module_id", "code", "severity", "start", F.col("value").alias("token"))


def definition_validity(definitions: DataFrame, parsed: DataFrame) -> DataFrame:
    """Whether a definition parsed, and whether it holds unsupported content."""
    facts = parsed.groupBy("module_id").agg(
        F.bool_or(F.coalesce(F.col("severity") == "error", F.lit(False))).alias("broken"),
        F.bool_or(F.col("kind") == "unsupported").alias("unsupported"))
    return definitions.select("module_id").join(facts, "module_id", "left").select(
        "module_id", (~F.coalesce("broken", F.lit(True))).alias("is_valid"), F.coalesce("unsupported", F.lit(False)).alias("unsupported"))


def module_components(definitions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Block texts, optional parts, referenced modules and member KOs (a definition is one bounded text)."""
    texts = nodes.join(definitions.select("module_id", "definition"), "module_id").withColumn(
        "text", F.substr("definition", F.col("start") + 1, F.col("end") - F.col("start")))

    def listed(condition: Column, value: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(condition, F.struct("node_id", F.col(value).alias("v"))))), lambda s: s["v"])

    return texts.groupBy("module_id").agg(
        listed(F.col("level") == 1, "text").alias("required_blocks"),
        listed(F.col("kind") == "optional", "text").alias("optional_parts"),
        F.array_distinct(listed(F.col("kind") == "module_reference", "value")).alias("referenced_modules"),
        F.array_distinct(listed(F.col("kind") == "ko", "value")).alias("member_kos"))


def module_tree(nodes: DataFrame) -> DataFrame:
    """Depth-first display table with the inherited optional flag."""
    label = F.when(F.col("value").isNotNull(), F.col("value")).otherwise(F.col("kind"))
    return nodes.select("module_id", "node_id", "parent_id", F.col("level").alias("depth"), label.alias("label"), "kind", "optional",
                        (F.col("kind") == "unsupported").alias("unsupported"))


def reference_edges(nodes: DataFrame) -> DataFrame:
    """module -> module references in source order."""
    return nodes.filter("kind = 'module_reference'").select(
        "module_id", F.col("value").alias("target_id"), "node_id", "start", "end")


def resolve_references(roots: DataFrame, edges: DataFrame, validity: DataFrame,
                       max_depth: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(reachable, issues) per root.

    ``reachable`` has the depth-first path of each module below a root: among all paths, the one whose
    reference positions come first. It is found by rounds of joins that keep the best path per
    (root, module), so a module shared by many paths stays one row. An edge is a cycle when its
    target is on the source's own path. Rounds end when no path is new, or at ``max_depth`` if given.
    """
    known = validity.select(F.col("module_id").alias("target_id"), "is_valid")
    best = roots.select(F.col("module_id").alias("root_id")).distinct().select(
        "root_id", F.col("root_id").alias("module_id"), F.array("root_id").alias("path"), F.array().cast("array<int>").alias("order"))
    usable = edges.join(known.filter("is_valid"), "target_id").select("module_id", "target_id", "node_id")
    valid_roots = validity.filter("is_valid").select(F.col("module_id").alias("root_id"))
    frontier = best.join(valid_roots, "root_id", "left_semi")
    for _ in count() if max_depth is None else range(max_depth):
        step = frontier.join(usable, "module_id").filter(~F.array_contains("path", F.col("target_id"))).select(
            "root_id", F.col("target_id").alias("module_id"), F.concat("path", F.array("target_id")).alias("path"),
            F.concat("order", F.array("node_id")).alias("order"))
        merged = best.withColumn("fresh", F.lit(False)).unionByName(step.withColumn("fresh", F.lit(True)))
        chosen = cut_lineage(merged.groupBy("root_id", "module_id").agg(
            F.min(F.struct("order", "path", "fresh")).alias("b")).select("root_id", "module_id", "b.path", "b.order", "b.fresh"))
        best, frontier = chosen.drop("fresh"), chosen.filter("fresh").drop("fresh")
        if frontier.isEmpty():
            break
    reachable = best.select("root_id", "module_id", "path", (F.size("path") - 1).alias("depth"))
    checked = reachable.join(edges, "module_id").join(known, "target_id", "left")
    kind = (
        F.when(F.array_contains("path", F.col("target_id")), F.lit("cycle"))
        .when(F.col("depth") + 1 > max_depth if max_depth is not None else F.lit(False), F.lit("depth_limit"))
        .when(F.col("is_valid").isNull(), F.lit("unresolved"))
        .when(~F.col("is_valid"), F.lit("invalid_definition"))
    )
    issues = checked.withColumn("issue", kind).filter("issue is not null").select(
        "root_id", "module_id", "target_id", "node_id", "issue", F.concat("path", F.array("target_id")).alias("path"))
    return reachable, issues


# --- evaluation --------------------------------------------------------------------------------

def compiled(nodes: DataFrame, reachable: DataFrame, issues: DataFrame) -> DataFrame:
    """One program per root, from the nodes of the modules it reaches. References with an issue are unknown.

    The work and the groups grow with the definitions, not with the sets.
    """
    blocked = issues.select("root_id", "module_id", "node_id", F.lit(True).alias("blocked")).distinct()
    rows = reachable.select("root_id", "module_id").join(
        nodes.select("module_id", "node_id", "parent_id", "block_index", "kind", "value"), "module_id").join(
        blocked, ["root_id", "module_id", "node_id"], "left").withColumn("blocked", F.coalesce("blocked", F.lit(False)))
    return rows.groupBy("root_id").applyInArrow(compile_root, PROGRAM)


def ko_bitmaps(accepted: DataFrame, key: str = "sample_id") -> DataFrame:
    """Each set's KO numbers as bitmap pieces: one shuffle of the pairs, and 16 KB a set at most."""
    number = F.substring("ko_id", 2, 5).cast("int")
    numbers = accepted.select(key, number.alias("number")).repartition(key)
    pieces = [F.bitmap_construct_agg(F.when(piece_of(F.col("number")) == k, (F.col("number") % PIECE).cast("long"))) for k in range(PIECES)]
    return numbers.groupBy(key).agg(F.array(*pieces).alias("bitmap"))


def _present(number: Column) -> Column:
    return bit_is_set(F.element_at("bitmap", piece_of(number) + 1), number % PIECE)


def node_truth(requests: DataFrame, programs: DataFrame, accepted: DataFrame, key: str = "sample_id") -> DataFrame:
    """Per requested (set, root): the program, which of its KOs are present, and the truth of all its values."""
    numbers = programs.select("root_id", F.transform("kos", lambda k: F.substring(k, 2, 5).cast("int")).alias("numbers"))
    asked = requests.select(key, F.col("module_id").alias("root_id")).join(numbers, "root_id")
    tested = computed(asked.join(ko_bitmaps(accepted, key), key, "left"), present=F.transform("numbers", _present)).drop("numbers", "bitmap")
    leaves = F.concat(F.transform("present", lambda x: F.when(x, TRUE).otherwise(FALSE)), F.array(F.lit(UNKNOWN), F.lit(TRUE)))

    def fold(values: Column, level: Column) -> Column:
        def value(node: Column) -> Column:
            below = F.transform(node["kids"], lambda k: values[k])
            return F.when(node["op"] == ONE_OF, F.array_max(below)).otherwise(F.array_min(below))

        return F.concat(values, F.transform(level, value))

    return computed(tested.join(programs, "root_id"), truth=F.aggregate("levels", leaves, fold))


def folded_blocks(truths: DataFrame, key: str = "sample_id") -> DataFrame:
    """One row per required block: truth, number of required parts, KOs found in it, also inside referenced modules."""
    rows = truths.select(key, "root_id", "kos", "present", "truth", "levels", F.explode("blocks").alias("b"))
    found = F.filter(F.col("b.leaves"), lambda k: F.col("present")[k])
    return rows.select(
        key, "root_id", "b.block_index", F.col("truth")[F.col("b.node")].alias("truth"), F.col("b.required").alias("required"),
        F.array_sort(F.transform(found, lambda k: F.col("kos")[k])).alias("matched"),
        F.struct("kos", "levels", F.col("b.node").alias("node")).alias("logic"))


def folded_optional(truths: DataFrame, key: str = "sample_id") -> DataFrame:
    """One row per optional part of the root and of the modules it refers to."""
    rows = truths.select(key, "root_id", "kos", "present", "truth", F.explode("optional").alias("o"))
    found = F.filter(F.col("o.leaves"), lambda k: F.col("present")[k])
    return rows.select(
        key, "root_id", "o.module_id", "o.node_id", F.col("truth")[F.col("o.node")].alias("truth"), (F.size(found) > 0).alias("any_matched"),
        F.array_sort(F.transform(found, lambda k: F.col("kos")[k])).alias("matched"))


def leaf_truth(nodes: DataFrame, requests: DataFrame, accepted: DataFrame, key: str = "sample_id") -> DataFrame:
    """Leaves of every requested module as rows with their truth: accepted KO, missing KO, or unknown."""
    leaves = nodes.filter("kind in ('ko', 'module_reference', 'unsupported')").select("module_id", "node_id", "block_index", "kind", "value")
    hits = accepted.select(key, F.col("ko_id").alias("value"), F.lit(True).alias("present"))
    joined = requests.select(key, "module_id").join(leaves, "module_id").join(hits, [key, "value"], "left")
    truth = F.when(F.col("kind") != "ko", UNKNOWN).when(F.col("present"), TRUE).otherwise(FALSE)
    return joined.select(key, "module_id", "node_id", "block_index", "kind", "value", truth.alias("truth"))


def evaluate(requests: DataFrame, definitions: DataFrame, accepted: DataFrame, key: str = "sample_id") -> dict[str, DataFrame]:
    """Evaluate every requested (set, module): blocks, optional parts, issues and facts per root.

    The parsed definitions and the programs are written once (checkpoints), and so are the requests, which several
    steps read; ``accepted`` is read once.
    """
    requests = written(requests.select(key, "module_id"))
    parsed = cut_lineage(parsed_definitions(definitions))
    nodes = module_nodes(parsed)
    validity = definition_validity(definitions, parsed)
    roots = requests.select("module_id").distinct()
    reachable, issues = resolve_references(roots, reference_edges(nodes), validity)
    programs = cut_lineage(compiled(nodes, reachable, issues))
    truths = node_truth(requests, programs, accepted, key)
    tainted = reachable.join(validity.select("module_id", "unsupported"), "module_id").groupBy("root_id").agg(
        F.bool_or("unsupported").alias("unsupported"))
    facts = roots.select(F.col("module_id").alias("root_id")).join(
        validity.select(F.col("module_id").alias("root_id"), "is_valid"), "root_id").join(tainted, "root_id", "left")
    return {
        "blocks": block_states(folded_blocks(truths, key), facts, key), "optional": optional_states(folded_optional(truths, key), facts, key),
        "issues": issues, "facts": facts, "nodes": nodes, "parsed": parsed, "reachable": reachable, "programs": programs,
    }


# --- results -----------------------------------------------------------------------------------

def block_states(blocks: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """State of each required block. Unsupported content anywhere below the root makes all unknown."""
    joined = blocks.join(facts, "root_id")
    hidden = F.col("unsupported") | (F.col("required") == 0)
    truth = F.when(hidden, UNKNOWN).otherwise(F.col("truth"))
    return joined.select(
        key, F.col("root_id").alias("module_id"), "block_index", truth.alias("truth"),
        ((F.col("required") == 0) & ~F.col("unsupported")).alias("no_required"),
        F.when(truth == TRUE, F.lit("complete")).when(truth == FALSE, F.lit("incomplete")).otherwise(F.lit("not_evaluable")).alias("state"),
        "required", F.when(hidden, F.array().cast("array<string>")).otherwise(F.col("matched")).alias("matched"), "logic")


def optional_states(optional: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Optional parts of the root and of referenced modules."""
    joined = optional.join(facts, "root_id")
    state = (
        F.when(F.col("unsupported") | (F.col("truth") == UNKNOWN), F.lit("not_evaluable"))
        .when(F.col("truth") == TRUE, F.lit("present"))
        .when(F.col("any_matched"), F.lit("partially_present")).otherwise(F.lit("absent")))
    matched = F.when(F.col("unsupported"), F.array().cast("array<string>")).otherwise(F.col("matched")).alias("matched")
    return joined.select(key, F.col("root_id").alias("module_id"), F.col("module_id").alias("source_module_id"), "node_id", state.alias("state"), matched)


def module_completion(requests: DataFrame, blocks: DataFrame, key: str = "sample_id") -> DataFrame:
    """Status, completion and coverage; coverage is NULL unless every block is evaluable."""
    counts = blocks.groupBy(key, "module_id").agg(
        F.count("*").alias("required_block_count"), F.count_if(F.col("truth") == TRUE).alias("completed_required_blocks"),
        F.count_if(F.col("truth") != UNKNOWN).alias("evaluable_required_blocks"))
    done, usable, total = (F.col(c) for c in ("completed_required_blocks", "evaluable_required_blocks", "required_block_count"))
    status = (
        F.when((total == 0) | (usable == 0), F.lit("not_evaluable")).when(usable < total, F.lit("partially_evaluable"))
        .when(done == total, F.lit("complete")).otherwise(F.lit("incomplete")))
    return (
        requests.join(counts, [key, "module_id"], "left").na.fill(0, ["required_block_count", "completed_required_blocks", "evaluable_required_blocks"])
        .withColumn("module_status", status)
        .withColumn("is_complete", F.when(F.col("module_status") == "complete", F.lit(True)).when(F.col("module_status") == "incomplete", F.lit(False)))
        .withColumn("block_coverage", F.when((total > 0) & (usable == total), done / total)))


_WALK = "module_id string, block_index int, kos array<string>, open boolean"


def _walks(batches: Iterator[pa.RecordBatch], cap: int | None) -> Iterator[tuple[dict, Alternatives | None]]:
    """Rows with their alternatives, None where a part is open or the bound is passed."""
    for batch in batches:
        for row in batch.to_pylist():
            logic = row["logic"]
            found = Alternatives(len(logic["kos"]), logic["levels"], folded(logic["kos"], logic["levels"], row["matched"]), cap)
            try:
                found.check(logic["node"])
            except TooMany:
                found = None
            yield row, found


def missing_rows(blocks: DataFrame, key: str = "sample_id", cap: int | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per minimal KO set that would complete an incomplete block: (key, module_id, block_index, kos, open).

    A block with an unknown part, or with more combinations than ``cap`` where one is given, gives one row with ``open``
    and no KOs: it fails closed. Blocks are walked in several tasks from about ``shard_rows`` candidates on; sets that
    several walks meet are made distinct by Spark.
    """
    kind = blocks.schema[key].dataType.simpleString()
    work = blocks.filter("state = 'incomplete'").select(key, "module_id", "block_index", "matched", "logic")

    def sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [0 if found is None else found.shards(row["logic"]["node"], shard_rows) for row, found in _walks(iter([batch]), cap)]
            yield batch.append_column("shards", pa.array(counts, pa.int32()))

    cut = work.mapInArrow(sharded, work.withColumn("shards", F.lit(0)).schema)
    each = cut.withColumn("shard", F.explode(F.sequence(F.lit(0), F.greatest(F.col("shards") - 1, F.lit(0)))))
    dealt = each.repartition(key, "module_id", "block_index", "shard")

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for row, found in _walks(batches, cap):
                base = (row[key], row["module_id"], row["block_index"])
                if found is None:
                    yield (*base, None, True)
                    continue
                kos = row["logic"]["kos"]
                for mask in found.minimal(row["logic"]["node"], row["shard"], max(1, row["shards"])):
                    yield (*base, sorted(kos[bit] for bit in bits_of(mask)), False)

        stream = rows()
        while part := list(islice(stream, _BATCH)):
            columns = list(zip(*part))
            types = [dealt_type, pa.string(), pa.int32(), pa.list_(pa.string()), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [key, "module_id", "block_index", "kos", "open"])

    dealt_type = to_arrow_type(blocks.schema[key].dataType)
    return dealt.mapInArrow(walked, f"`{key}` {kind}, {_WALK}").distinct()


def missing_alternatives(blocks: DataFrame, limit: int, key: str = "sample_id", cap: int | None = None) -> DataFrame:
    """The ``limit`` smallest minimal KO sets of each incomplete block, and whether that is not all of them.

    Incomplete blocks are written once. Each distinct case (block and KOs found in it) is walked and ranked once,
    however many sets share it; the answers are written too, so that Spark knows their size when it joins them.
    """
    case, group = ["module_id", "block_index", "matched"], ["case", "module_id", "block_index"]
    lacking = written(blocks.filter("state = 'incomplete'").select(key, *case, "logic"))
    cases = written(lacking.select(*case, "logic").distinct().withColumn("case", F.monotonically_increasing_id()))
    order = W.partitionBy(*group).orderBy(F.size("kos"), "kos")
    rows = missing_rows(cases.withColumn("state", F.lit("incomplete")), "case", cap)
    ranked = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit + 1)
    listed = F.array_sort(F.collect_list(F.when(~F.col("open") & (F.col("rank") <= limit), F.struct("rank", "kos"))))
    answers = ranked.groupBy(*group).agg(
        F.transform(listed, lambda s: s["kos"]).alias("alternatives"), F.bool_or(F.col("open") | (F.col("rank") > limit)).alias("truncated"))
    known = written(answers.join(cases.drop("logic"), group).drop("case"))
    asked = lacking.drop("logic").distinct()  # a block asked for twice is one row
    return asked.join(known, case).select(key, "module_id", "block_index", "alternatives", "truncated")


def module_warnings(completion: DataFrame, blocks: DataFrame, issues: DataFrame, facts: DataFrame, alternatives: DataFrame, key: str = "sample_id") -> DataFrame:
    """Warning codes per (set, module) in reporting order; ``alternatives`` tells which blocks' lists are cut."""
    kinds = issues.groupBy("root_id").agg(
        F.bool_or(F.col("issue").isin("unresolved", "invalid_definition")).alias("unresolved"),
        F.bool_or(F.col("issue") == "cycle").alias("cycle"), F.bool_or(F.col("issue") == "depth_limit").alias("depth"))
    roots = facts.join(kinds, "root_id", "left").withColumnRenamed("root_id", "module_id")
    per = blocks.groupBy(key, "module_id").agg(F.bool_or("no_required").alias("no_required"))
    cut = alternatives.groupBy(key, "module_id").agg(F.bool_or("truncated").alias("cut"))
    joined = completion.join(roots, "module_id", "left").join(per, [key, "module_id"], "left").join(cut, [key, "module_id"], "left")
    flags = (F.col("unsupported") | ~F.col("is_valid"), F.col("unresolved"), F.col("cycle"), F.col("depth"),
             F.col("module_status") == "partially_evaluable", F.col("no_required"), F.col("cut"))
    codes = F.array_compact(F.array(*[F.when(flag, F.lit(code)) for flag, code in zip(flags, WARNING_CODES)]))
    return joined.select(key, "module_id", codes.alias("warnings"))
