"""Benchmark: every registered query on $BENCH_SF_DIR with local[$BENCH_CPUS].

Each query is built and fully executed into Spark's ``noop`` sink (the whole
plan runs, nothing is pulled to the driver); one warm-up run, then the median
of $BENCH_RUNS timed runs.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]

    from growthlens.plans.registry import all_queries
    from growthlens.session import get_spark

    spark = get_spark(app="growthlens-bench", master=f"local[{cpus}]", shuffle_partitions=cpus * 2,
                      extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g"),
                             "spark.sql.files.maxPartitionBytes": str(64 * 1024 * 1024)})
    spark.sparkContext.setLogLevel("ERROR")

    queries = all_queries()
    names = only or sorted(queries)
    times: dict[str, float] = {}
    failed: dict[str, str] = {}
    for name in names:
        q = queries[name]
        samples = []
        try:
            for i in range(runs + 1):
                t0 = time.perf_counter()
                q.build(spark, sf_dir).write.format("noop").mode("overwrite").save()
                dt = time.perf_counter() - t0
                if i > 0:
                    samples.append(dt)
            times[name] = round(statistics.median(samples), 4)
        except Exception as e:  # noqa: BLE001 -- report and keep going
            failed[name] = f"{type(e).__name__}: {str(e)[:200]}"
    out = {
        "metric": "sum_of_median_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
        "cpus": cpus,
        "runs": runs,
        "spark": spark.version,
    }
    if failed:
        out["failed"] = failed
    print(json.dumps(out))


if __name__ == "__main__":
    main()
