"""KO sets and target outcomes of several labelled inputs in one long table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthoflow.operators import compare as C


def compare_sets(sets: DataFrame, inputs: DataFrame, pathways: DataFrame, modules: DataFrame | None = None) -> DataFrame:
    """(section, item, value): the part of every KO and whether a target's outcomes differ."""

    def differing(frame: DataFrame, target: str) -> DataFrame:
        return frame.select(F.col(target).alias("item"), F.when(F.col("outcomes_differ"), F.lit("differ")).otherwise(
            F.lit("same")).alias("value"))

    kos = C.compare_ko_sets(sets, inputs).select(
        F.col("ko_id").alias("item"),
        F.concat_ws(":", F.col("part"), F.array_join(F.col("members").cast("array<string>"), ";")).alias("value"))
    parts = {"ko": kos, "pathway": differing(pathways, "pathway_id")}
    if modules is not None:
        parts["module"] = differing(modules, "module_id")
    return C.long_table(**parts).select("section", "item", "value")
