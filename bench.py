"""Time the headline queries and print one JSON line.

Each query runs once to warm up and then ROUNDS times; its time is the median. A run
builds the query and computes every row of the result. Queries that write (roll-ups,
tables, streams) are timed with their writes.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidegauge import build_session  # noqa: E402
from workload import QUERIES  # noqa: E402

ROUNDS = 3

HEADLINE = (
    "time_range",
    "time_range_limit",
    "bucket_agg_1h",
    "bucket_agg_all_metrics",
    "last_point",
    "last_point_agg",
    "tag_agg",
    "downsample_1m",
    "downsample_1h",
    "downsample_1d",
    "downsample_multi",
    "window_sweep_bucket",
    "window_sweep_tag",
    "infer_roles",
    "generate_iot",
    "write_parquet",
    "ingest_append",
    "bucket_tag_agg",
    "rollup_create",
    "rollup_query",
    "rollup_refresh",
    "latency_percentiles",
    "summarize",
    "stream_tumbling",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__ui__enabled="false", spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:] or HEADLINE
    times = {name: round(timed(spark, QUERIES[name], folder), 4) for name in wanted}
    print(
        json.dumps(
            {
                "metric": "total_median_seconds",
                "value": round(sum(times.values()), 4),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )


def timed(spark, run, folder: str) -> float:
    taken = []
    for _round in range(ROUNDS + 1):
        began = time.perf_counter()
        run(spark, folder).write.format("noop").mode("overwrite").save()
        taken.append(time.perf_counter() - began)
    return statistics.median(taken[1:])


if __name__ == "__main__":
    main()
