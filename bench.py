"""Benchmark: run the headline queries at ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) on ``local[$BENCH_CPUS]`` and print one JSON line.

Each query is forced with a ``noop`` write (full computation, nothing pulled
to the driver). A warm-up pass runs every headline query once on the
smallest data set first, so JVM start-up, JIT and code generation are not
charged to whichever query happens to run first. ``BENCH_EVENT_LOG=<dir>``
writes Spark's event log there (stage and task times).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gridwright.plans.catalog import QUERIES  # noqa: E402
from gridwright.session import build_session  # noqa: E402

HEADLINE = [
    "inspection_water_systems",   # flagship: grid → bind → clean → keep-first → project
    "grid_normalize",
    "entity_normalize",
    "deficiency_rows",
    "dedup_keep_first",
    "dedup_composite",
    "exclude_patterns",
    "schema_project",
    "flatten_record",
    "coverage",
    "stop_rules",
    "keyset_scan",
    "offset_page",
    "running_progress",
    "event_stats",
    "error_classify",
    "range_rules",
    "url_rules",
    "issue_summary",
    "html_rows",
    "csv_roundtrip",
    "html_tables",
    "schedule_tables",
    "inspection_document",
    "json_envelope",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(cores=cpus, shuffle_partitions=max(8, int(cpus) * 2) if cpus.isdigit() else 16,
                          event_log_dir=os.environ.get("BENCH_EVENT_LOG"))
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(warm_dir):
        warm_dir = sf_dir
    for name in names:  # warm-up pass
        QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
