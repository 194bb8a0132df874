"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose the data and the local cores. Every query runs to the end
(all columns, ``noop`` sink); its time is the median of three runs after one warm-up.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
os.environ.setdefault(
    "PYSPARK_SUBMIT_ARGS", f"--master local[{CPUS}] --driver-memory 12g pyspark-shell"
)

from reelfold.plans.registry import QUERIES  # noqa: E402
from reelfold.session import build_session  # noqa: E402

HEADLINE = [
    "a1_current_state", "a2_build_catalog", "a3_snapshot", "a4_restore", "a5_progress_latest",
    "w1_assign_seq", "w2_keep_latest", "w3_running_state", "f1_search", "f2_list_all",
    "p2_catalog_json", "p6_preferences_json", "v7_read_preferences", "v8_read_media",
    "v10_quarantine", "j1_requests_with_state", "j2_resolve_path", "j3_route_to",
    "j4_broadcast_messages", "c3_plan_conversion", "h7_event_tag", "s3_reassemble_chunks",
    "s4_chunk_files", "t1_project_by_tag", "t2_state_stream", "t3_dedupe_replays",
    "x1_fold_events",
]


def run(spark, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = build_session(
        "reelfold-bench",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in wanted:
        run(spark, name)
        seconds[name] = round(statistics.median(run(spark, name) for _ in range(RUNS)), 3)
        print(name, seconds[name], file=sys.stderr)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
