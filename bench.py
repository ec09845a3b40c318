"""Wall times of the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import re
import time

from repovigil.plans import registry
from repovigil.session import local_session, ship_package

HEADLINE = [
    "detect_framework", "filter_files", "cleaning_stats", "sort_by_path", "render_tree", "lookup_files",
    "similar_files", "file_messages", "discover_endpoints", "group_crud_flows", "build_checklists", "trace_imports",
    "match_controls", "scan_vulnerabilities", "scan_vulnerabilities_documents", "scan_vulnerabilities_pages",
    "findings", "report_summary", "security_score", "run_metrics", "extract_first_json", "parse_checklist",
    "retry_rounds_checklists", "render_inspection_prompts", "job_view", "job_replay", "progress_from_logs",
    "job_state_stream", "read_archives", "scan_scores",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench")
    ship_package(spark)
    # start the engine and read one table, so that the first query is not charged for it
    spark.read.parquet(f"{folder}/lineitem.parquet").selectExpr("sum(l_quantity)").collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale.group(1)) if scale else folder,
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
