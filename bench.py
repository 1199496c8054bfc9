"""Time the headline queries and print one JSON line.

Each query runs to a no-op sink (every row is produced, none is collected), once to warm up and once
measured. BENCH_SF_DIR and BENCH_CPUS choose the tables and the number of local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from evidex.plans import load_checks  # noqa: E402
from evidex.plans.views import Catalog  # noqa: E402
from evidex.session import build  # noqa: E402

HEADLINE = ["ranked_search", "tiering", "page_then_rollup", "evidence_rollup", "fuzzy_join", "similar_items", "facet_counts", "interval_join",
            "link_second_pass", "change_detect", "newest_snapshot", "asof_head", "mark_fold", "status_progress", "page_index", "cover_rank",
            "token_support", "color_match", "filename_facts", "json_products", "bulk_replay", "upsert_items", "upsert_children", "dq_suite"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = build(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("OFF")
    checks = load_checks()
    timings: dict[str, float] = {}
    for name in wanted:
        for _ in range(2):
            start = time.perf_counter()
            checks[name].run(Catalog(spark, sf_dir)).write.format("noop").mode("overwrite").save()
            timings[name] = round(time.perf_counter() - start, 3)
    searches = Catalog(spark, sf_dir).searches.count()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings,
        "sf": os.path.basename(sf_dir.rstrip("/")), "searches_per_batch": searches,
        "ms_per_search": round(1000 * timings["ranked_search"] / max(searches, 1), 3) if "ranked_search" in timings else None}))
    spark.stop()


if __name__ == "__main__":
    main()
