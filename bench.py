"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from sitegrain.catalog import all_queries
from sitegrain.session import local_session

HEADLINE = (
    "page_audits", "page_text", "route_pages", "internal_links", "technical_fields", "content_quality",
    "link_plan", "link_suggestions", "shop_link_suggestions", "known_links", "reachable_pages",
    "document_phrases", "search_intel", "content_gaps", "keyword_clusters", "sanitized_text",
    "evaluation", "content_scores", "structure_signals", "crawl_diff", "cost_report", "run_report",
    "run_artifacts", "dimension_rows", "contract_violations", "planned_sites", "serp_expansion",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "sitegrain-bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf}/pages.parquet").count()
    seconds = {}
    for name in names:
        started = time.time()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
