"""Intake to ranking, selection, coverage and completion: the main analysis in one call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthoflow.operators import coverage as V
from orthoflow.operators import modules as M
from orthoflow.operators import relations as R
from orthoflow.operators.evidence import accepted_kos
from orthoflow.session import written


def analyze_targets(records: DataFrame, relations: DataFrame, pathways: DataFrame, links: DataFrame, modules: DataFrame,
                    key: str = "sample_id", top_n: int = R.DEFAULT_TOP_N) -> dict[str, DataFrame]:
    """Accepted sets, rankings, and the coverage and completion of the ``top_n`` targets of every set.

    The accepted sets are written once: intake is the only part that reads annotation rows, and every
    later step works on distinct (set, KO) pairs. The selected targets are written too, as several steps read them.
    """
    accepted = written(accepted_kos(records, key))
    normalized = {name: R.normalized_relations(relations, name) for name in ("ko_to_pathway", "ko_to_module")}
    rankings = {name: R.ranked_overlap(accepted, rows, key) for name, rows in normalized.items()}
    counted = {name: R.ranked_overlap(accepted, rows, key, limit=0) for name, rows in normalized.items()}  # the selection needs no lists of KOs
    top_pathways = written(R.top_targets(counted["ko_to_pathway"], top_n, R.BROAD_PATHWAYS, key).select(key, F.col("target_id").alias("pathway_id")))
    top_modules = written(R.top_targets(counted["ko_to_module"], top_n, key=key).select(key, F.col("target_id").alias("module_id")))
    targets = V.link_targets(links)
    coverage = V.coverage(top_pathways, accepted, V.pathway_kos(targets), V.build_reference(pathways, targets), key)
    requests = top_modules.join(modules.select("module_id", "module_name"), "module_id")
    evaluated = M.evaluate(requests, modules, accepted, key)
    return {
        "accepted": accepted, "pathway_ranking": rankings["ko_to_pathway"], "module_ranking": rankings["ko_to_module"],
        "coverage": coverage, "completion": M.module_completion(requests, evaluated["blocks"], key), "blocks": evaluated["blocks"],
    }


def summary_rows(coverage: DataFrame, completion: DataFrame, key: str = "sample_id") -> DataFrame:
    """Long table of completion and coverage per set and target for display tools."""
    paths = coverage.select(key, F.lit("pathway").alias("target_kind"), F.col("pathway_id").alias("target_id"),
                            F.col("evaluation_status").alias("status"), F.col("coverage_ratio").alias("ratio"),
                            F.col("detected_kos").alias("numerator"), F.col("reference_kos").alias("denominator"),
                            F.when(F.col("evaluation_status") == "evaluated", F.lit("renderable")).otherwise(F.lit("summary_only")).alias("renderability"))
    mods = completion.select(key, F.lit("module").alias("target_kind"), F.col("module_id").alias("target_id"),
                             F.col("module_status").alias("status"), F.col("block_coverage").alias("ratio"),
                             F.col("completed_required_blocks").alias("numerator"), F.col("required_block_count").alias("denominator"),
                             F.when(F.col("required_block_count") > 0, F.lit("renderable")).otherwise(F.lit("summary_only")).alias("renderability"))
    return paths.unionByName(mods)
