"""Headline queries, timed. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the data and the cores.
"""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lakeledger import run_scope  # noqa: E402
from lakeledger.plans.queries import QUERIES  # noqa: E402

HEADLINE = (
    "file_records classify_default classify_rules classify_rules_vectorised rule_hits incremental snapshot_diff "
    "upsert_catalog scan scan_stats session_stats category_share browse browse_search browse_after dup_stage1 "
    "dup_stage2 duplicates dup_members dup_summary plan_preview plan_moves organize_summary undo_plan list_logs "
    "debounce debounce_by_path event_counts apply_changes apply_events"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        best = None
        for _ in range(2):   # the first run warms the JVM
            started = time.perf_counter()
            with run_scope(spark):
                QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            spent = time.perf_counter() - started
            best = spent if best is None else min(best, spent)
        times[name] = round(best, 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
