"""Time headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "prd_13_search_counts", "prd_13_search_page", "prd_1_keyword",
    "rul_1_brute_force", "rul_2_brute_force_success", "rul_3_new_account_privilege_grant",
    "rul_4_persistence_after_login", "rul_6_wiped_history", "rul_9_timeline_gap", "rul_10_backwards_timestamps",
    "rul_12_first_seen", "rul_13_suspicious_process", "win_6_fifo_pairs", "win_9_stitched_runs",
    "rpt_4_sessions", "rpt_11_remote_ips", "rpt_24_failures_per_hour",
    "xtr_2_auth_log", "xtr_4_journal", "xtr_7_audit_trail", "xtr_12_apt_history", "xtr_14_web_access",
    "out_1_deduplicated_batch", "out_4_content_digest", "int_1_manifest_verification",
)


def main() -> None:
    from fleetlens.plans.catalogue import QUERIES
    from fleetlens.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session("bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    # One small query first: starting the JVM and loading Spark's classes is no property of a query.
    QUERIES["agg_2_span"](spark, sf_dir).collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        # noop writes every row of every column, and nothing goes through the driver.
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
