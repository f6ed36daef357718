"""Times the headline queries: one JSON line on stdout.

Every query is planned and run to a sink that discards rows. ``BENCH_SF_DIR``
names the data folder, ``BENCH_CPUS`` the number of threads. With ``--all``
every registered query is timed.
"""
from __future__ import annotations

import json
import os
import sys
import time

from parley.plans import catalogue
from parley.session import build_session

HEADLINE = [
    "get_devops_daily", "get_devops_summary", "get_devops_latency_percentiles", "get_devops_weekly_comparison",
    "get_tech_rag_daily", "get_tech_rec_gap_analysis", "get_tech_catalog_gaps", "tech_summary", "agent_tech_summary",
    "get_business_session_outcomes", "get_business_conversion_funnel", "get_business_outcome_by_intent",
    "get_business_engagement_score", "get_business_satisfaction_by_category", "agent_conversion",
    "top_products_mentioned", "session_outcomes", "dashboard_status", "enrich_turns", "category_detection",
    "hybrid_candidates", "retrieval_stats", "review_summaries", "load_reviews", "upsert_documents",
    "reviews_recent", "star_distribution", "order_pricing", "order_status_updates", "cart_contents",
    "apply_product_changes", "rate_limit", "injection_spikes", "latency_alerts", "chart_latency_p95",
    "rolling_summary", "rollup_period",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("parley-bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
                          spark__ui__enabled="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalogue.queries()
    names = list(queries) if "--all" in sys.argv else HEADLINE
    runs = int(os.environ.get("BENCH_RUNS", "1"))

    def once(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    once("get_devops_daily")  # start-up of the session is not part of any query
    seconds = {name: round(min(once(name) for _ in range(runs)), 3) for name in names}
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
