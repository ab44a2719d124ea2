"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Each query runs once to warm up, then BENCH_RUNS times (default 3); the median counts. Results
are consumed with the ``noop`` sink, so every row is produced and none reaches the driver.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from watchloom.plans import QUERIES  # noqa: E402

HEADLINE = (
    "normalize_event", "dead_letter", "run_summary", "fixed_window_agg", "tumbling_window", "session_agg",
    "session_window", "session_events", "session_ordinal", "gap_to_previous", "sort_events_text",
    "stream_retention", "activity_features", "baseline_score", "analyze_sequence", "temporal_correlation",
    "decision", "threshold_sweep", "latency_distribution", "weight_grid_sweep", "token_session",
    "session_window_orders", "tumbling_window_lineitem", "lexicon_weight", "topk_similarity", "stream_session",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("watchloom-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        spent = []
        for _ in range(runs + 1):
            begin = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            spent.append(time.perf_counter() - begin)
        times[name] = round(statistics.median(spent[1:]), 3)
        print(f"{name} {times[name]} (first {spent[0]:.2f})", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
