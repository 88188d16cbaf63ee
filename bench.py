"""Wall time of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from crewlake.plans.registry import load_all
from crewlake.session import local_session

HEADLINE = [
    "timesheet_summary", "winning_sheet", "opms_hours", "gap_pairs", "split_midnight", "roster_summary", "weekly_timesheet",
    "employee_profile", "training_compliance", "project_hours_status", "purchase_summary", "ppe_transactions", "invoice_register",
    "revenue_summary", "check_roster_risk", "find_deployable_workers", "worker_360", "kpis", "trend_deltas", "parity",
    "scrub_secrets", "upsert", "resolve_mentions", "chunks", "vector_search", "keyword_search", "usage_report", "failure_streaks",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8)))
    spark = local_session(cpus)
    registered = load_all()
    # one throw-away query so that JVM start and class loading are not charged to the first one
    registered["dim_project"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total wall time of headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": sf_dir.rsplit("sf", 1)[-1], "cpus": cpus, "spark": spark.version,
        "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions")}))


if __name__ == "__main__":
    main()
