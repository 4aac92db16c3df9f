"""Print the executed physical plan of registered queries (after running them),
with a summary of shuffles, broadcasts, scans and pushed filters.

Usage: python tools/explain.py [sf_dir] name [name ...]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from growthlens.plans.registry import all_queries  # noqa: E402
from growthlens.session import get_spark  # noqa: E402


def summarize(plan: str) -> str:
    shuffles = len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition|"
                              r"Exchange RoundRobin", plan))
    bcast = len(re.findall(r"BroadcastExchange", plan))
    smj = len(re.findall(r"SortMergeJoin", plan))
    bhj = len(re.findall(r"BroadcastHashJoin", plan))
    scans = re.findall(r"Scan parquet \S*", plan)
    pushed = re.findall(r"PushedFilters: \[[^\]]*?(?:\]|\.\.\.)", plan)
    schemas = re.findall(r"ReadSchema: struct<[^>]*>", plan)
    return (f"shuffles={shuffles} broadcasts={bcast} smj={smj} bhj={bhj} scans={len(scans)}\n"
            + "\n".join(f"   {p}" for p in sorted(set(pushed)))
            + "\n" + "\n".join(f"   {s}" for s in sorted(set(schemas))))


def main():
    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.1"
    if args and os.path.isdir(args[0]):
        sf_dir, args = args[0], args[1:]
    spark = get_spark(master="local[8]", shuffle_partitions=16)
    spark.sparkContext.setLogLevel("ERROR")
    qs = all_queries()
    for n in args:
        df = qs[n].build(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        print(f"==== {n}")
        print(summarize(plan))
        if os.environ.get("FULL"):
            print(plan)


if __name__ == "__main__":
    main()
