"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "flagship_growth_panel", "coverage_report", "crosswalk_as_of", "feature_panel_wide", "cbsa_sum", "lineage_trace", "ver_conflicts", "ver_gaps_jumps", "readiness_funnel", "target_panel", "benchmark_matrix",
    "lead_lag", "walk_forward", "market_holdout", "rent_comps_topk", "nearest_by_category", "screening_tiers", "candidate_list", "deal_reconciliation", "classify_docs", "extract_fields", "publish_and_scan", "forecast",
)


def main() -> None:
    from parcelflow.plans import registry
    from parcelflow.session import local_session

    registry.load()
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session("bench", cores)
    registry.QUERIES["flagship_growth_panel"](spark, sf_dir).count()  # warm the JVM
    seconds = {}
    for name in names:
        started = time.time()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
