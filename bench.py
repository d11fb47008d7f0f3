"""Benchmark the headline query plans.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is executed in full through the ``noop`` sink (nothing is
collected to the driver). One warm-up query runs first; every headline query
is then timed once. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "text_normalize_hash", "content_dedup", "listing_upsert", "observations", "parse_card_fields",
    "correct_locality", "regex_extract_record", "llm_response_normalize", "enrich_fill", "feature_matrix",
    "baseline_deals", "top_deals", "share_deals", "regression_metrics", "locality_rollup", "bi_measures",
    "deals_board", "extractor_scorecard", "price_changes", "days_on_market", "nearest_station",
    "cards_from_pages", "fk_violations", "stream_dedup",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [a for a in sys.argv[1:] if not a.startswith("-")]
    from rentlens.plans import registry
    from rentlens.session import get_session
    registry.load_all()
    spark = get_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2,
                        extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})

    def run(name: str) -> float:
        t0 = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    run("dedup_key_buckets")  # warm-up: JVM, codegen caches, file listing
    times = {}
    for name in only or HEADLINE:
        times[name] = round(run(name), 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                      "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
