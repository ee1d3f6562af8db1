"""Genomes whose organism code is spelled like a reserved prefix keep their taxonomy."""

from __future__ import annotations

from orthoflow.operators import trace as T


def test_reserved_code_of_a_known_genome_is_traced(spark):
    genomes = spark.createDataFrame([("T00001", "pmid"), ("T00002", "hsa")], "t_number string, code string")
    relations = spark.createDataFrame(
        [("genome_to_taxonomy", "gn:pmid", "taxid:11", 0), ("genome_to_taxonomy", "genome:hsa", "tax:12", 0), ("genome_to_taxonomy", "gn:none", "taxid:13", 0)],
        "relationship string, source_id string, target_id string, batch_index int")
    rows = T.genome_to_taxonomy(genomes, relations).select("t_number", "taxonomy_id").collect()
    assert sorted(map(tuple, rows)) == [("T00001", "taxid:11"), ("T00002", "taxid:12")]
