"""Time the registered queries; print one JSON line.

    BENCH_SF_DIR   data folder (default /root/testdata/sf0.1)
    BENCH_CPUS     local[N] threads (default 8)
    BENCH_REPEAT   runs per query (default 3): the best counts, and the least,
                   median and greatest are given beside it

Each query runs to completion through a ``noop`` sink, so the whole plan
executes but nothing is collected to the driver.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    from parlance.registry import QUERIES
    from parlance.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = max(1, int(os.environ.get("BENCH_REPEAT", "3")))
    spark = build_session(
        "parlance-bench",
        master=f"local[{cpus}]",
        shuffle_partitions=cpus,
        extra={
            "spark.ui.showConsoleProgress": "false",
            # local mode: the driver JVM is also the only executor
            "spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "8g"),
        },
    )

    def run(fn) -> float:
        t0 = time.perf_counter()
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    run(QUERIES["dispatch_commands"])  # warm-up: JIT, file listing caches
    times, spread = {}, {}
    for name, fn in QUERIES.items():
        runs = sorted(run(fn) for _ in range(repeat))
        times[name] = round(runs[0], 3)
        spread[name] = [round(runs[0], 3), round(statistics.median(runs), 3), round(runs[-1], 3)]
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "min_median_max": spread,
                "sf": float(m.group(1)) if m else sf_dir,
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
