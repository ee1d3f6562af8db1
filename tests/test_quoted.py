"""Quoted delimited records across splits against Python's reader."""

from __future__ import annotations

import csv
import io
import random
import time

import pytest

from orthoflow.sources import quoted as Q
from orthoflow.sources import text_tables as L

SPLIT_SETTING = "spark.sql.files.maxPartitionBytes"


def split_read(spark, size, read):
    old = {k: spark.conf.get(k) for k in (SPLIT_SETTING, "spark.sql.files.openCostInBytes")}
    for k in old:
        spark.conf.set(k, str(size))
    try:
        return read()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def python_records(text, sep):
    reader = csv.reader(io.StringIO(text, newline=""), delimiter=sep)
    return [(reader.line_num, cells) for cells in reader]


def random_table(seed, sep, breaks=("\n", "\r\n", "\n\n", '"', '""', sep := ",", "a", "é", " ")):
    rng = random.Random(seed)
    out = io.StringIO()
    writer = csv.writer(out, delimiter=sep, lineterminator=rng.choice(["\n", "\r\n"]), quoting=rng.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL]))
    writer.writerow(["id", "name", "note"])
    for k in range(rng.randint(1, 40)):
        writer.writerow([k, *["".join(rng.choices([*breaks, sep, "x" * rng.randint(1, 30)], k=rng.randint(0, 9))) for _ in range(2)]])
    return out.getvalue()


@pytest.mark.parametrize(("seed", "sep", "size"), [(1, ",", 90), (2, "\t", 200), (3, "|", 60), (4, ",", 1 << 20), (5, ";", 40)])
def test_records_equal_python_reader(spark, tmp_path, seed, sep, size):
    wanted = []
    for k in range(3):
        text = random_table(seed * 10 + k, sep)
        (tmp_path / f"{k}.csv").write_bytes(text.encode())
        wanted += [(k, line, cells) for line, cells in python_records(text, sep)]
    found = split_read(spark, size, lambda: L.table_cells(Q.read_records(spark, str(tmp_path), sep), sep).collect())
    assert not [r for r in found if r["fault"]]
    assert sorted((int(r["source_id"][-5]), r["line_no"], r["cells"]) for r in found) == sorted(wanted)
    if size < 100 and len(text) > 400:
        assert split_read(spark, size, lambda: spark.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions()) > 3


def test_long_record_over_many_splits_and_unclosed_quote(spark, tmp_path):
    body = "\n".join(f"line {k}" for k in range(400))
    (tmp_path / "a.csv").write_text(f'id,note\n1,"{body}"\n2,x\n\n3,"y""z"\n4,"no end\n5,x\n6,"y\n')
    header, cells, faults = split_read(spark, 100, lambda: Q.read_table(spark, str(tmp_path)))
    assert header == ["id", "note"]
    rows = split_read(spark, 100, lambda: cells.orderBy("line_no").collect())
    assert [(r["line_no"], r["first_line_no"], r["cells"]) for r in rows] == [(401, 2, ["1", body]), (402, 402, ["2", "x"]), (404, 404, ["3", 'y"z']), (407, 405, None)]
    # The quote of line 405 is closed by that of line 407, as any reader takes it; what follows makes the record malformed.
    assert [(r["line_no"], r["first_line_no"], r["line"], r["fault"]) for r in split_read(spark, 100, faults.collect)] == []


def test_file_that_ends_inside_a_cell(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,note\n1,x\n2,"open\n3,y\n' + "4,z\n" * 50)
    header, cells, faults = split_read(spark, 40, lambda: Q.read_table(spark, str(tmp_path)))
    assert [r["cells"] for r in split_read(spark, 40, cells.collect)] == [["1", "x"]]
    assert [(r["line_no"], r["first_line_no"], r["line"], r["fault"]) for r in split_read(spark, 40, faults.collect)] == [(54, 3, '2,"open', "unclosed_quote")]


def test_malformed_cells_marks_and_headers(spark, tmp_path):
    one, two = tmp_path / "one", tmp_path / "two"
    one.mkdir()
    two.mkdir()
    (one / "a.csv").write_bytes('﻿id,note\r\n1,"a"b\r\n2,in "the" middle\r\n3,"c\r\nd"\r\n'.encode())
    header, cells, faults = Q.read_table(spark, str(one))
    assert header == ["id", "note"] and faults.count() == 0
    assert [(r["line_no"], r["cells"]) for r in cells.orderBy("line_no").collect()] == [(2, None), (3, ["2", 'in "the" middle']), (5, ["3", "c\r\nd"])]
    assert [r["line"] for r in L.malformed_rows(cells).collect()] == ['1,"a"b']
    assert [(r["line_no"], r["id"], r["note"]) for r in Q.read_rows(spark, str(one)).orderBy("line_no").collect()] == [(3, "2", 'in "the" middle'), (5, "3", "c\r\nd")]
    (two / "a.csv").write_text("id,note\n1,x\n")
    (two / "b.csv").write_text("id,other\n1,x\n")
    with pytest.raises(ValueError, match="common"):
        Q.read_table(spark, str(two))


def test_wide_quoted_line_costs_its_length(spark):
    wide = ",".join(['"x, ""y"" "'] + ["v"] * 100_000)
    lines = spark.createDataFrame([("f", 1, wide), ("f", 2, 'a,"b"')], "source_id string, line_no long, line string")
    start = time.perf_counter()
    rows = L.table_cells(lines, ",").collect()
    assert time.perf_counter() - start < 10
    assert [len(r["cells"]) for r in rows] == [100_001, 2] and rows[0]["cells"][0] == 'x, "y" ' and rows[1]["cells"] == ["a", "b"]
