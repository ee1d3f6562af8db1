"""Run registered queries beside their SQL in DuckDB and compare schema, row count and values.

    python tests/verify.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from orthoflow.session import local_session  # noqa: E402
from orthoflow.workload import ORACLES, QUERIES  # noqa: E402
from orthoflow.workload.views import TABLES  # noqa: E402


def canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (list, tuple)):
        return tuple(canonical(item) for item in value)
    return value if value is None or isinstance(value, (int, str)) else str(value)


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(canonical(row[i]) for i in order) for row in rows)


KIND = {"bigint": "int", "int": "int", "smallint": "int", "tinyint": "int", "INTEGER": "int", "BIGINT": "int", "HUGEINT": "huge",
        "double": "float", "DOUBLE": "float", "string": "str", "VARCHAR": "str", "boolean": "bool", "BOOLEAN": "bool"}


def check(spark, con, folder, name):
    start = time.time()
    frame = QUERIES[name](spark, folder)
    rows = [tuple(row) for row in frame.collect()]
    seconds = time.time() - start
    if name not in ORACLES:
        return f"rows-only {len(rows)}", seconds
    result = con.sql(ORACLES[name])
    theirs_columns, theirs_types = result.columns, [str(t) for t in result.types]
    theirs = result.fetchall()
    ours_columns, ours = bag(frame.columns, rows)
    their_columns, their = bag(theirs_columns, theirs)
    if ours_columns != their_columns:
        return f"COLUMNS {ours_columns} <> {their_columns}", seconds
    kinds = {c: KIND.get(t, t) for c, t in frame.dtypes}
    their_kinds = {c: KIND.get(t, t) for c, t in zip(theirs_columns, theirs_types)}
    if kinds != their_kinds:
        return f"TYPES { {c: (kinds[c], their_kinds[c]) for c in kinds if kinds[c] != their_kinds[c]} }", seconds
    if ours != their:
        a, b = list((ours - their).items())[:3], list((their - ours).items())[:3]
        return f"VALUES {ours_columns} ours={len(rows)} theirs={len(theirs)} only-ours={a} only-theirs={b}", seconds
    if not rows:
        return "ok but EMPTY", seconds
    return f"ok {len(rows)}", seconds


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = local_session("verify")
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{args.sf}/{table}.parquet'")
    bad = 0
    names = args.names or list(QUERIES)
    for name in names:
        try:
            outcome, seconds = check(spark, con, args.sf, name)
        except Exception as error:  # noqa: BLE001
            outcome, seconds = f"ERROR {type(error).__name__}: {str(error)[:1500]}", 0.0
        good = outcome.startswith(("ok ", "rows-only")) and "EMPTY" not in outcome
        bad += not good
        print(f"{name:32s} {seconds:6.2f}s {outcome}", flush=True)
    print(f"{len(names)} queries, {bad} to look at")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
