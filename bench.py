"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from buildlens.session import local_session, scratch_scope

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "ingest_runs",
    "upsert_builds",
    "upsert_runs",
    "purge_retention_groups",
    "invalidate_issues",
    "tag_hits",
    "issues_console",
    "issues_all",
    "stock_issues",
    "similar_pairs",
    "similarity_members",
    "similarity_summary",
    "latest_builds",
    "run_status_counts",
    "job_health",
    "issues_found",
    "unknown_runs",
    "view_matches",
    "view_by_metadata",
    "job_builds",
    "run_issue_panel",
    "top_usage_summary",
    "junit_failures",
]


def main() -> None:
    from buildlens.plans.queries import QUERIES

    spark = local_session(CPUS, int(CPUS))
    QUERIES["run_status_counts"](spark, SF_DIR).collect()  # start the executors
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        with scratch_scope(spark):
            QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
