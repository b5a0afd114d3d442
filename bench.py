"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR: data directory. BENCH_CPUS: local cores. Each query is run once to warm up
and then three times; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tracemill.queries import QUERIES  # noqa: E402
from tracemill.session import local_session  # noqa: E402

HEADLINE = [
    "task_category_distribution", "stg_conversations", "int_messages_enriched", "int_tool_usage",
    "int_sessions_computed", "dim_date", "dim_projects", "dim_sessions", "dim_tools", "fct_messages",
    "fct_tool_calls", "fct_file_operations", "agg_session_metrics", "agg_tool_efficiency", "agg_code_changes",
    "agg_daily_summary", "agg_hourly_activity", "activity_by_day", "page_newest", "search_words",
    "upsert_result", "flatten_documents", "checks_staging",
]


def seconds(query, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, "bench")
    times = {}
    for name in HEADLINE:
        seconds(QUERIES[name], spark, sf_dir)
        times[name] = round(statistics.median(seconds(QUERIES[name], spark, sf_dir) for _ in range(3)), 3)
    scale = os.path.basename(sf_dir).removeprefix("sf")
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "session_log_models_total", "value": total, "unit": "sec", "queries": times, "sf": float(scale)}))
    spark.stop()


if __name__ == "__main__":
    main()
