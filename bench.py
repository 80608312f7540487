"""Wall time of the headline queries; prints one JSON line.

The queries run in pipeline order in one session and share stage tables, so
each time is what a query adds to the ones before it and the value is the
time of the whole run.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from adit.checks.queries import registered

HEADLINES = (
    "zscore",
    "rolling_mean",
    "window_sample",
    "las_scan",
    "segments",
    "slice_features",
    "geometry_risk",
    "worker_timeline",
    "gas_timeline",
    "reliability",
    "edge_impact",
    "graph_risk",
    "hop_route",
    "fused_timeline",
    "topk_per_step",
    "emergency_scenario",
    "playback_panel",
    "emergency_route",
    "nearest_segment",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in sys.argv[1:] or HEADLINES:
        start = time.perf_counter()
        registered()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
