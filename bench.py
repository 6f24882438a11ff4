"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from cellarmark.plans.catalog import all_queries
from cellarmark.session import local_session

HEADLINE = [
    "permit_match_summary", "permit_tier", "brand_summary", "brand_facet_page", "facet_counts", "overview", "geo", "hhi_cr", "top_brands",
    "market_report", "priority_rank", "tier_stats", "data_health", "sku_upsert", "upload_counters", "brand_merge", "core_brand", "domain_hierarchy",
    "approvals", "web_score", "domain_patterns", "enhanced_confidence", "pattern_fold", "trailing_hour_count", "failure_streak", "contact_top", "importer_brands", "merge_execution",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")
    registered = all_queries()
    registered["table_stats"](spark, sf_dir).collect()  # warm the JVM
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.time()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
