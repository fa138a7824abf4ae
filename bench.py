"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from fleetsight.plans.workload import QUERIES  # noqa: E402

HEADLINE = [
    "normalize_fields",
    "json_lines_scan",
    "predicate_matrix",
    "simple_signals",
    "rule_match_counts",
    "artifact_first_seen",
    "baseline_first_seen",
    "first_seen_stats",
    "correlation_count",
    "correlation_distinct",
    "correlation_global",
    "correlation_fleet_count",
    "correlation_prefilter",
    "correlation_signals",
    "process_chain",
    "process_tree",
    "ingest_validation",
    "ingest_dedupe",
    "status_update",
    "signal_search",
    "signal_stats",
    "latest_heartbeat",
    "outbox_pending",
    "detect_all",
]


def run(spark: SparkSession, name: str, sf_dir: str) -> float:
    """Seconds to plan the query and produce all of its rows."""
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("fleetsight-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        run(spark, name, sf_dir)
        seconds[name] = round(run(spark, name, sf_dir), 3)
    print(json.dumps({
        "metric": "total warm query time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"),
        "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
