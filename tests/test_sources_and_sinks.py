from __future__ import annotations

import random
import tempfile
from pathlib import Path

from pyspark.sql import functions as F

from orthoflow.operators import compare as C
from orthoflow.operators import hierarchy as H
from orthoflow.operators import relations as R
from orthoflow.sinks import exports as X
from orthoflow.sinks import tables as S
from orthoflow.sources import fasta, flatfile, mapxml
from orthoflow.sources import text_tables as L


def folder() -> Path:
    return Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


def test_line_numbers_survive_file_splits(spark):
    path = folder() / "lines.txt"
    path.write_text("".join(f"line {i}\n" for i in range(1, 2001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        rows = L.read_lines(spark, str(path)).orderBy("line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r.line_no, r.line) for r in rows] == [(i, f"line {i}") for i in range(1, 2001)]


def test_plain_list(spark):
    texts = spark.createDataFrame([("f", " K00001\n\nko:K00001\r\nK00002\nbad")], "source_id string, text string")
    rows = L.plain_ko_records(L.lines_of(texts)).orderBy("row_number").collect()
    assert [(r.row_number, r.ko_id, r.status) for r in rows] == [
        (1, "K00001", "accepted"), (3, "K00001", "accepted"), (4, "K00002", "accepted"), (5, None, "invalid")]


def test_flat_file_reader(spark):
    path = folder() / "entries.txt"
    entry = lambda k: f"ENTRY       {k}   KO\nNAME        one; two\n            three\nMODULE      M00001  name\n///\n"
    path.write_text(entry("K00001") + entry("K00002") + "BROKEN\n///\n")
    entries = flatfile.parse_entries(flatfile.read_flat_files(spark, str(path)))
    good = entries.filter("fault is null").orderBy("identifier").collect()
    assert [r.identifier for r in good] == ["K00001", "K00002"]
    assert [(f.name, f.lines) for f in good[0].fields][1] == ("NAME", ["one; two", "three"])
    assert [r.fault for r in entries.filter("fault is not null").collect()] == ["invalid_field_columns"]


def test_flat_file_terminators(spark):
    body = lambda k, end: f"ENTRY       {k}   KO{end}NAME        x///{end}"
    want = [("K00001", True), ("K00002", True), ("K00003", False)]
    for end, mark in (("\n", "///"), ("\r\n", "///"), ("\n", "/// "), ("\r\n", "///\t")):
        path = folder() / "entries.txt"
        path.write_text(body("K00001", end) + mark + end + body("K00002", end) + mark + end + body("K00003", end), newline="")
        records = flatfile.read_flat_files(spark, str(path))
        entries = flatfile.parse_entries(records).orderBy("record_no").collect()
        assert [(r.identifier, r.terminated) for r in entries] == want and all(r.fields[1].lines == ["x///"] for r in entries)
        assert [(r.record_no, r.fault) for r in flatfile.unterminated(records).collect()] == [(3, "unterminated_entry")]


def test_strict_quoting(spark):
    lines = ['x,"a ""q""",z', '"""k""",b,c', 'ab"c,d,e', '"abc,d,e', '"a"b,c,d', "a,,", '"x,y","",', "1,2,3,4"]
    frame = spark.createDataFrame([("f", i, line) for i, line in enumerate(lines)], "source_id string, line_no long, line string")
    cells = L.table_cells(frame, ",")
    assert [r.cells for r in cells.orderBy("line_no").collect()] == [
        ["x", 'a "q"', "z"], ['"k"', "b", "c"], ['ab"c', "d", "e"], None, None, ["a", "", ""], ["x,y", "", ""], ["1", "2", "3", "4"]]
    assert sorted((r.line_no, r.fault) for r in L.malformed_rows(cells).collect()) == [(3, "malformed_quoting"), (4, "malformed_quoting")]
    named = lambda header: [e.name for e in L.ragged_rows(cells.filter("line_no = 7"), header).first().evidence]
    assert named(["a", "b", "c"]) == ["a", "b", "c", "_extra_1"]
    assert named(["a", "b", "_extra_1"]) == ["a", "b", "_extra_1", "_extra_1_1"]
    path = folder() / "t.csv"
    path.write_text('a,b\n"one\ntwo",x\n')
    assert [tuple(r) for r in L.read_table(spark, str(path), ",", ["a", "b"], line_breaks=True).collect()] == [("one\ntwo", "x")]


def test_lines_are_written_in_the_callers_order(spark):
    rows = [("g1" if i % 3 else "g2", i, f"gene{i}", "K00001") for i in range(2000)]
    random.Random(4).shuffle(rows)
    frame = spark.createDataFrame(rows, "genome_id string, position int, gene_id string, ko_id string").repartition(6)
    checked = X.ko_sequence(frame)
    path = folder() / "all"
    assert X.write_lines(checked, str(path), order="position") and not X.write_lines(checked, str(path) + "_any")
    text = "".join(p.read_text() for p in sorted(path.glob("part-*")))
    assert text.split() == [x for i in range(2000) for x in (f"gene{i}", "K00001")]
    assert X.manifest(checked, "ko_sequence", "\t").first().order_preserved is False


def test_hierarchy_paths_of_any_depth(spark):
    text = "\n".join(f"{chr(65 + d)}{' ' * d} node {d}" for d in range(9))
    lines = spark.createDataFrame([("h", i + 1, line) for i, line in enumerate(text.split("\n"))], "hierarchy_id string, line_no long, line string")
    paths = H.hierarchy_paths(H.hierarchy_nodes(lines)).collect()
    assert all(len(r.path) == r.depth + 1 and r.path[-1].depth == r.depth for r in paths) and len(paths) == 9


def test_fasta_reader(spark):
    path = folder() / "p.fasta"
    path.write_text(">a first\nacd\nEF*\n>b\nMK1\n>a\nM\n")
    parsed = fasta.sequences(fasta.read_fasta(spark, str(path)))
    rows = sorted((r.sequence_id, r.residues, r.fault) for r in parsed.collect())
    assert rows == [("a", "ACDEF*", None), ("a", "M", None), ("b", "MK1", "invalid_residue")]
    assert [r.sequence_id for r in fasta.duplicate_identifiers(parsed).collect()] == ["a"]


def test_map_xml_reader(spark):
    path = folder() / "ko00010.xml"
    path.write_text('<pathway name="path:ko00010"><entry id="1" name="ko:K00002 ko:K00001"><graphics type="rectangle" x="10" y="20" width="4" height="6"/></entry>'
                    '<entry id="2" name="cpd:C00001"><graphics type="circle" x="1" y="1" width="1" height="1"/></entry>'
                    '<entry id="3" name="ko:K00003"><graphics type="line" coords="0,0,3,4"/><graphics type="line" coords="1,1,1,1"/></entry></pathway>')
    rows = mapxml.graphics(mapxml.read_map_entries(spark, str(path))).orderBy("entry_id", "fault").collect()
    assert [(r.pathway_id, r.entry_id, r.kind, r.ko_ids, r.fault) for r in rows] == [
        ("ko00010", 1, "box", ["K00001", "K00002"], None), ("ko00010", 3, "polyline", ["K00003"], None), ("ko00010", 3, "polyline", ["K00003"], "degenerate_line")]


def test_hierarchy_paths_across_chunks(spark):
    lines = ["#note", "A09100 Metabolism", "B  Carbohydrate metabolism", "C    00010 Glycolysis", "D      K00001 first enzyme",
             "B  Alternative functions", "C    Unnumbered category", "D K00001", "D K00002"]
    frame = spark.createDataFrame([("br00001", i, line) for i, line in enumerate(lines)], "hierarchy_id string, line_no long, line string")
    nodes = H.hierarchy_nodes(frame)
    assert H.level_gaps(nodes, chunk=3).count() == 0
    entities = spark.createDataFrame([("ko", f"K0000{i}") for i in (1, 2, 3)], "kind string, identifier string")
    paths = H.entity_paths(entities, H.hierarchy_paths(nodes, levels=4, chunk=3))
    assert paths.count() == 3
    assert [r.identifier for r in H.unmatched_entities(entities, paths).collect()] == ["K00003"]
    root = H.prefix_counts(paths).filter(F.size("prefix") == 1).collect()
    assert [(r.prefix[0].name, r.n) for r in root] == [("Metabolism", 2)]
    assert H.first_paths(paths).count() == 2


def test_ranking_merges_paired_views(spark):
    relations = spark.createDataFrame([("ko_to_pathway", "ko:K00001", t, 0, i) for i, t in enumerate(("path:ko00020", "path:map00020", "path:ko00020"))],
                                      "relationship string, source_id string, target_id string, batch_index int, line_number int")
    accepted = spark.createDataFrame([("s", "K00001")], "sample_id string, ko_id string")
    row = R.rank_targets(R.target_overlap(accepted, R.normalized_relations(relations, "ko_to_pathway"))).first()
    assert (row.target_id, row.detected_kos, row.relation_rows, row.rank) == ("ko00020", 1, 3, 1)


def test_three_sets(spark):
    members = {0: "K00001 K00002 K00003 K00008 K00009", 1: "K00002 K00003 K00005 K00009", 2: "K00002 K00003 K00007"}
    sets = spark.createDataFrame([(i, k) for i, kos in members.items() for k in kos.split()], "input_index long, ko_id string")
    inputs = spark.createDataFrame([(i, "p", "1") for i in members], "input_index long, policy_name string, policy_version string")
    assert C.ko_union(sets).count() == 7
    assert sorted(r.ko_id for r in C.shared_by_all(sets, inputs).collect()) == ["K00002", "K00003"]
    assert sorted((r.input_index, r.ko_id) for r in C.set_specific(sets).collect()) == [(0, "K00001"), (0, "K00008"), (1, "K00005"), (2, "K00007")]
    patterns = C.partial_patterns(C.with_input_count(C.membership(sets), inputs)).collect()
    assert [(r.members, r.ko_ids) for r in patterns] == [([0, 1], ["K00009"])]


def test_exports_write_lines_in_order(spark):
    rows = spark.createDataFrame([("g", 2, "b", "K00001"), ("g", 1, "a", "K00001"), ("g", 3, "c", "K1")], "genome_id string, position int, gene_id string, ko_id string")
    checked = X.ko_sequence(rows)
    assert {r.gene_id: r.violation for r in checked.collect()} == {"a": None, "b": None, "c": "invalid_ko"}
    path = folder() / "out"
    X.write_lines(checked, str(path), "genome_id", "position")
    text = "".join(p.read_text() for p in sorted(path.glob("genome_id=g/part-*")))
    assert text == "a\tK00001\nb\tK00001\n"


def test_written_table_round_trip(spark):
    path = folder() / "accepted"
    accepted = spark.createDataFrame([("s", "K00002"), ("s", "K00001")], "sample_id string, ko_id string")
    S.write_tsv(S.accepted_ko_table(accepted, "sample_id"), str(path), ("sample_id", "ko_id"))
    assert sorted(r.ko_id for r in L.read_table(spark, str(path), "\t", ["sample_id", "ko_id", "evidence_status"]).collect()) == ["K00001", "K00002"]
