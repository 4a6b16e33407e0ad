"""Seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], the median of three runs after one to warm up: one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

from inkfold.plans import registry
from inkfold.session import local_session

HEADLINE = (
    "convert_text", "text_blocks", "text_wrap_pages", "html_blocks", "html_outline", "block_metrics", "span_join", "two_column_bands", "frames", "kv_gap_clusters",
    "continuity_edges", "heading_nesting", "tree_preorder", "splice_order", "vote_majority", "verdicts", "dedupe_inputs", "conversions_page",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    heap = os.environ.get("BENCH_MEMORY", "8g")
    spark = local_session(int(cpus) if cpus.isdigit() else cpus, "bench", **{"spark.driver.memory": heap})
    names = sys.argv[1:] or list(HEADLINE)
    seconds: dict[str, float] = {}
    for name in names:
        runs = []
        for _ in range(4):  # the first warms the JVM up
            began = time.perf_counter()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        seconds[name] = round(median(runs[1:]), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(sf) if sf.replace(".", "").isdigit() else sf, "cpus": cpus, "heap": heap, "runs": 3}))


if __name__ == "__main__":
    main()
