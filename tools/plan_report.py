"""Summarise the physical plan of every registered query into PLANS.md:
shuffles (by kind), broadcasts, nested-loop joins, windows, Python nodes and
pushed filters, so plan regressions show up in review.

Usage: ``python tools/plan_report.py [sf_dir] > PLANS.md``. Queries that write
intermediates (round trips, streams, exports) are planned after their writes.
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gridwright.plans import catalog_runs  # noqa: E402,F401  (registers its queries)
from gridwright.plans.catalog import QUERIES  # noqa: E402
from gridwright.session import build_session  # noqa: E402

PATTERNS = {
    "hash shuffles": r"Exchange hashpartitioning",
    "range shuffles": r"Exchange rangepartitioning",
    "single-partition": r"Exchange SinglePartition",
    "broadcasts": r"BroadcastExchange",
    "nested-loop joins": r"BroadcastNestedLoopJoin|CartesianProduct",
    "sort-merge joins": r"SortMergeJoin",
    "windows": r"\bWindow \[",
    "partial aggs": r"partial_",
    "python": r"MapInPandas|MapInArrow|BatchEvalPython|ArrowEvalPython|FlatMapGroupsInPandas",
    "pushed filters": r"PushedFilters: \[[^\]]",
    "subqueries": r"Subquery subquery",
}


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session()
    print("# Physical plan summary\n")
    print(f"Generated by `tools/plan_report.py` on `{sf_dir}` (initial plans, before AQE re-planning; "
          "AQE may still turn a sort-merge join into a broadcast at run time when a side is small).\n")
    print("| query | " + " | ".join(PATTERNS) + " |")
    print("| --- |" + " --- |" * len(PATTERNS))
    for name, fn in QUERIES.items():
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            fn(spark, sf_dir).explain()
        plan = buf.getvalue()
        counts = [str(len(re.findall(p, plan))) for p in PATTERNS.values()]
        print(f"| {name} | " + " | ".join(counts) + " |")
    spark.stop()


if __name__ == "__main__":
    main()
