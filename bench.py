"""Time the headline queries and print one JSON line, with the file scans and shuffles of each final plan.

    BENCH_SF_DIR=/root/testdata/sf0.01 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from orthoflow.session import local_session
from orthoflow.workload import QUERIES

HEADLINE = (
    "policy_marker_threshold", "row_diagnostics", "accepted_kos", "duplicate_records", "conflicting_assignments",
    "import_report", "rank_pathways", "pathway_coverage", "missing_kos", "mapping_yield", "ko_partial_patterns",
    "hierarchy_prefix_counts", "trace_relations", "resolve_genes", "snapshot_diff", "scan_flat_file", "module_completion",
)


def main() -> int:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session("bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/lineitem.parquet").count()
    seconds, plans = {}, {}
    for name in names:
        start = time.perf_counter()
        frame = QUERIES[name](spark, folder)
        frame.write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        plan = frame._jdf.queryExecution().executedPlan().toString()
        plans[name] = {"file_scans": plan.count("FileScan "), "shuffles": len(re.findall(r"\bExchange ", plan))}
    match = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({
        "metric": "total wall time of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "plans": plans, "sf": float(match.group(1)) if match else folder}))
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
