"""Headline queries, timed: one warm-up, then the median of three runs. Prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import SparkSession

from framelens.plans import registered

HEADLINE = {
    "jn1_match_identity": "jn1_match_identity",
    "set4_nms": "set4_nms",
    "trk1_track": "trk1_track",
    "set5_plan_windows": "set5_plan_windows",
    "set6_stitch": "set6_stitch",
    "agg1_span_summary": "agg1_span_summary",
    "agg18_tree_hash": "agg18_tree_hash",
    "win6_boundary_jump": "win6_boundary_jump",
    "flagship": "flagship_track_quality",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("framelens-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.local.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    built = registered()
    times, rows = {}, {}
    for label, name in HEADLINE.items():
        runs = []
        for attempt in range(4):
            started = time.perf_counter()
            built[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if attempt:
                runs.append(time.perf_counter() - started)
        times[label] = round(statistics.median(runs), 3)
        rows[label] = built[name](spark, sf_dir).count()
    print(json.dumps({
        "metric": "total_median_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "rows_per_sec": {label: round(rows[label] / max(seconds, 1e-9)) for label, seconds in times.items()},
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
