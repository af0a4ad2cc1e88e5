"""Time the headline queries; prints one JSON line.

Reads BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gaugelake.session import session  # noqa: E402
from gaugelake.workloads import all_queries  # noqa: E402

HEADLINE = (
    "row_counts_by_date", "analogue_aggregates", "digital_state_rates", "sampling_gaps",
    "sampling_gaps_by_user", "profile_nulls", "profile_quantiles", "profile_cardinality",
    "profile_duplicate_excess", "profile_gap_summary", "profile_largest_gaps",
    "boundary_findings", "interval_summaries", "continuity_report", "month_gap_counts",
    "selection_findings", "run_identity", "cross_day_duplicates", "raw_scan",
    "row_rule_issues", "batch_metrics", "daily_manifest", "month_compaction",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(
        "gaugelake-bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
            "spark.driver.memory": "16g", "spark.sql.session.timeZone": "UTC",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    queries["row_counts_by_date"](spark, sf_dir).collect()  # start the engine
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(scale.group(1)) if scale else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
