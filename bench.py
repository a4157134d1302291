"""Headline queries at one scale; prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS`` (default 8).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pagestrata.plans import catalog
from pagestrata.session import local_session

WARM_DIR = "/root/testdata/sf0.001"
#: Seconds from which a query is run once.
LONG = 8
HEADLINE = (
    "assign_owner", "detection_items", "overlap_edges", "resolve_overlaps", "suppress_non_max", "reading_order", "dedupe_text_regions",
    "region_order", "resolve_canon_id", "init_translation", "sync_from_canon", "summarize_canon", "page_status", "masked_pixels",
    "item_inpaint_boxes", "filter_ocr_text", "text_rules_by_line", "term_usage", "priority_terms", "story_summary", "export_manifest",
    "luma_profile", "progress_rollup",
)


def run(spark, name: str, sf_dir: str) -> float:
    start = time.time()
    catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.time() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    picks = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in picks:
        run(spark, name, WARM_DIR)
        took = [run(spark, name, sf_dir)]
        while len(took) < 3 and took[0] < LONG:
            took.append(run(spark, name, sf_dir))
        times[name] = round(statistics.median(took), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": f"headline queries after a run on the smallest tables, median of three runs, one run from {LONG} s on", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
