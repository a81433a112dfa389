"""Times the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]`` and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from larder.plans import catalog
from larder.session import local_session

HEADLINE = [
    "review_stats",
    "search_page",
    "search_text",
    "search_sorted_page_created",
    "unified_reviews",
    "place_profiles_flat",
    "favorite_places",
    "repair_roundtrip",
    "review_fields",
    "place_import_counts",
    "review_upsert_counts",
    "create_reviews_outcome",
    "update_places_state",
    "cascade_delete_counts",
    "quality_report",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = os.environ.get("BENCH_QUERIES", "").split()
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.read.parquet(f"{sf_dir}/region.parquet").count()
    seconds = {}
    for name in only or HEADLINE:
        started = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
