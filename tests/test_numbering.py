"""Record numbers: only the needed columns are moved, and source rows that share a row number have fixed places."""

from __future__ import annotations

from orthoflow.operators import intake as K
from orthoflow.sinks import tables as S
from orthoflow.workload import QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_only_kept_columns_are_written(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(K, "written", lambda frame, write=K.written: seen.append(frame.columns) or write(frame))
    for name in ("record_numbering", "records_by_ko", "write_normalized_annotations", "write_protein_ko_mapping"):
        QUERIES[name](spark, FOLDER)
    places = {"_part", "_seq"}
    assert [set(columns) - places for columns in seen] == [
        {"dataset_id", "row_number", "pos"}, {"dataset_id", "ko_id"}, {"dataset_id", *S.ANNOTATION_COLUMNS}, {"dataset_id", *S.PROTEIN_KO_COLUMNS}]


def test_numbers_are_joined_without_a_shuffle_of_the_records(spark):
    plan = QUERIES["record_numbering"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_tied_source_rows_have_fixed_ids_that_tables_share(spark):
    cells = [("d", "s1", 7, "p", "K00002", "accepted"), ("d", "s1", 7, "p", "K00001", "accepted"), ("d", "s0", 7, "p", "K00003", "accepted"), ("d", "s9", 1, "p", "K00004", "accepted")]
    wanted = {"K00004": "record-000001", "K00003": "record-000002", "K00001": "record-000003", "K00002": "record-000004"}
    for rows in (cells, cells[::-1]):
        records = spark.createDataFrame(
            [(d, s, n, 0, q, None, ko, ko, status, "", None, None, None, None, None) for d, s, n, q, ko, status in rows],
            "dataset_id string, sample_id string, row_number long, pos int, sequence_id string, protein_name string, ko_id string, raw_ko string, status string, reason string,"
            "score double, threshold double, rank bigint, domain_start bigint, domain_end bigint").repartition(3)
        for table, keep in ((S.normalized_annotation_table, S.ANNOTATION_COLUMNS), (S.protein_ko_table, S.PROTEIN_KO_COLUMNS)):
            made = table(K.number_records(records, K.RECORD_ORDER, keep=keep)).select("ko_id", "record_id").collect()
            assert dict(map(tuple, made)) == wanted
