"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "mentions_per_company", "extracted_mentions", "mention_variations", "kb_fuzzy_search", "government_dependency",
    "ownership_integrity", "merged_companies", "scored_articles", "entity_scores", "trailing_request_counts",
    "request_timing", "sliding_limit", "page_entities",
]


def main() -> None:
    from ownerscope.plans import registry
    from ownerscope.session import PARTITIONS, get_session

    registry.load_all()
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(cores)
    # the text tables at this scale are one row group each
    spark.conf.set(PARTITIONS, str(2 * int(cores)))
    # JVM warm-up on a small aggregate, not on the measured queries
    spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderpriority").count().collect()
    seconds: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - t0, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
