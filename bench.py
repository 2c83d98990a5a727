"""Time the registered queries and print one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the cores, ``BENCH_ONLY`` an
optional comma-separated list of query names.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from doccensus.plans import registry
from doccensus.session import local_session

# one query per family and shape of plan
HEADLINE = [
    "audit_site_grades", "u1_normalize_url", "u7_resolve_url", "u13_slug_typos", "h1_visible_text", "h7_headings",
    "h9_link_density", "h18_link_summary", "h22_main_text", "h26_doc_confidence", "h27_structural_signals",
    "r2_crawler_status", "r5_bot_access_state", "l1_llms_entries", "l3_to_crawl", "l4_page_mapping",
    "l9_expand_sitemap_index", "p3_first_success", "p5_classify_link", "p8_health_summary", "p9_evidence_signals",
    "g4_recommendations", "g5_merge_recommendations", "g10_weighted_overall", "c4_competing_domains", "i3_merge_classification",
    "i6_keyword_page_match", "i8_similar_pages", "i10_issue_status", "i20_relevant_docs", "s8_upsert_kb", "s9_split_cached",
    "x2_apply_fixes", "o1_daily_usage", "o3_allowed_events", "o8_latest_category_result", "ss1_daily_usage_stream",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "doccensus-bench")
    only = [x for x in os.environ.get("BENCH_ONLY", "").split(",") if x]
    names = list(registry.QUERIES) if only == ["all"] else only or HEADLINE
    # start the JVM and the code cache before the clock
    registry.QUERIES["u10_input_type"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
