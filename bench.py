"""Time the headline queries and print one JSON line.

BENCH_SF_DIR: folder of the parquet tables; BENCH_CPUS: local cores.
Each query is run once to warm up, then three times; the median counts. Results
go to Spark's noop sink, so that every row is computed and none is collected.
"""

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ticklane.plans import derive  # noqa: E402
from ticklane.plans.registry import QUERIES  # noqa: E402

HEADLINE = [
    "kpi_report",
    "kpi_basic",
    "collisions",
    "lap_times",
    "downsample_10",
    "downsample_1000",
    "season_detail",
    "newest_run",
    "run_enriched",
    "cascade_set",
    "frame_asof",
    "log_type_counts",
    "quarantine",
    "replay_runs",
    "replay_telemetry",
    "replay_summary",
    "state_vector",
    "shaped_reward",
    "transitions",
    "packet_parse",
    "packet_controls",
    "record_defaults",
    "flatten_fields",
    "raw_zone_roundtrip",
]
ONCE = ["stream_runs"]
REPEATS = 3


def seconds(run) -> float:
    began = time.perf_counter()
    run()
    return time.perf_counter() - began


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("ticklane-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> None:
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

    times = {
        "derive_tables": seconds(
            lambda: [make(spark, sf_dir) for make in (derive.telemetry, derive.runs, derive.messages)]
        )
    }
    for name in HEADLINE:
        run(name)
        times[name] = statistics.median(seconds(lambda: run(name)) for _ in range(REPEATS))
    for name in ONCE:
        times[name] = seconds(lambda: run(name))
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": {name: round(t, 3) for name, t in times.items()},
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
