"""Times the headline queries end to end and prints one JSON line.

Each query is timed from reading the parquet tables to its full result, after
one untimed run of the flagship query that starts the engine.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from portolan.plans import catalog  # noqa: E402
from portolan.plans.session import local_session  # noqa: E402

HEADLINE = (
    "trade_direction", "top_partners", "top_products", "yearly_trends", "summary_report",
    "value_distribution", "concentration", "correlations", "balance_openness", "growth_stats", "trend",
    "export_share_latest", "trade_intensity", "export_complexity", "economic_complexity", "market_penetration",
    "product_opportunities", "competitive_position", "competitive_rank", "partner_profile", "emerging_partners",
    "product_profile", "balance_by_partner", "risk_indicators", "density_clusters", "unmatched_references",
    "top_partners_all_reporters", "value_distribution_all_reporters", "concentration_all_reporters",
    "trend_all_reporters", "product_opportunities_all_reporters", "competitive_position_all_reporters",
    "density_summary_all_reporters", "silhouette_of_labels", "kmeans_sweep", "partner_segments", "result_document",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "portolan-bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    queries["top_partners"](spark, sf_dir).toArrow()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).toArrow()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
