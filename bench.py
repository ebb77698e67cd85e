"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from outings.plans import QUERIES  # noqa: E402
from outings.session import local_session  # noqa: E402

HEADLINE = (
    "recommend", "topn_per_request", "score_vibe", "score_hybrid", "score_matrix",
    "popular_recommendations", "semantic_topk", "semantic_scores", "upsert_events",
    "upcoming_by_week", "stats_counts", "infer_categories", "ics_events", "jsonld_events",
    "html_cards", "apply_feedback", "stream_ingest",
)


def run(query, spark, path: str) -> float:
    start = time.perf_counter()
    query(spark, path).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, "bench", partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    run(QUERIES["scan_places"], spark, path)  # start the engine before the clock
    times = {}
    for name in HEADLINE:
        times[name] = round(min(run(QUERIES[name], spark, path) for _ in range(2)), 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": path.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
