"""Entry texts are dealt to all cores, parsed once and read once, whatever the split of the file."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from orthoflow.functions import entries as E
from orthoflow.operators import cards as C
from orthoflow.session import SPREAD_SETTING
from orthoflow.workload import QUERIES
from orthoflow.workload.views import PARTS_PER_CORE, Inputs

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def as_split(spark):
    spread = spark.conf.get(SPREAD_SETTING)
    spark.conf.unset(SPREAD_SETTING)
    yield spark
    spark.conf.set(SPREAD_SETTING, spread)


def scans(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString().count("parquet")


def test_entries_of_one_split_are_dealt_to_all_cores(as_split):
    entries = Inputs(as_split, SMALL).view("v_flat_text")
    assert entries.rdd.getNumPartitions() == PARTS_PER_CORE * as_split.sparkContext.defaultParallelism


def test_field_counts_need_no_shuffle_of_field_rows(as_split):
    plan = QUERIES["flat_file_fields"](as_split, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # of the table's rows


def test_references_cut_each_line_once():
    assert str(E.references("PATHWAY", E.PATHWAY_REFERENCE)).count("split(") == 1


@pytest.mark.parametrize("name", ["reference_list", "literature_summary"])
def test_the_table_is_read_once(as_split, name):
    assert scans(QUERIES[name](as_split, SMALL)) == 1


def test_references_keep_the_first_label_and_stop_at_a_bad_token(spark):
    lines = ["K00001  first", "K00001  again", "K00002 K00003", "K00004 x K00005", "no id", "K00006"]
    fields = F.array(F.struct(F.lit("ORTHOLOGY").alias("name"), F.lit(0).alias("indent"), F.array(*map(F.lit, lines)).alias("lines")))
    row = spark.range(1).select(fields.alias("fields")).select(E.references("ORTHOLOGY", C.KO).alias("r")).first()
    assert [tuple(r) for r in row["r"]] == [("K00001", "first"), ("K00002", None), ("K00003", None), ("K00004", "x K00005"), ("K00006", None)]


def test_literature_of_cards_without_ids(spark):
    cards = spark.createDataFrame([(["1", "2"],), (["2"],), ([],), (None,)], "pubmed_ids array<string>")
    assert tuple(C.literature_summary(cards).first()) == (4, 2, 2)
    assert tuple(C.literature_summary(cards.limit(0)).first()) == (0, 0, 0)
