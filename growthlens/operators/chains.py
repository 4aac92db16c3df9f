"""Ordered funnels: the longest chain of steps, each later than the one before, per user and item.

First times alone cannot tell whether a user who bought before viewing came
back and went through all steps afterwards.  Here a chain is followed through
the events themselves.

The events of a user and item are cut into time buckets.  A bucket is
summed up as a state machine: for each step at which a chain may enter the
bucket, the times of the further steps it takes there.  That is one row of
bounded width however many events there are, and the rows of neighbouring
buckets compose in order.  A pair that holds a third of the log is thus worked on
in as many tasks as it has buckets, and only one row per bucket goes on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STEPS = ("pv", "fav", "cart", "buy")
DAY = 86_400


def _transitions(events: DataFrame, steps: Sequence[str], width: int) -> DataFrame:
    """(user_id, item_id, bucket, moves): ``moves[s]`` holds the times of the steps after ``s`` steps that a chain takes in the bucket."""
    known = events.where(F.col("user_id").isNotNull() & F.col("item_id").isNotNull() & F.col("ts").isNotNull() & F.col("action").isin(*steps))
    rows = known.select("user_id", "item_id", F.array_position(F.array(*map(F.lit, steps)), F.col("action")).cast("int").alias("step"),
                        F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    keys = ["user_id", "item_id", "bucket"]
    # repeated events go before the shuffle
    rows = rows.withColumn("bucket", F.floor(F.col("t") / width).cast("long")).distinct()
    # the first time of step k after the one before it, for chains that enter at step s; all windows share one exchange
    whole = Window.partitionBy(*keys)
    name = lambda s, k: f"_m{s}_{k}"
    n = len(steps)
    for reach in range(n):
        later = lambda s, k: F.lit(True) if k == s + 1 else F.col("t") > F.col(name(s, k - 1))
        rows = rows.select("*", *(
            F.min(F.when((F.col("step") == s + reach + 1) & later(s, s + reach + 1), F.col("t"))).over(whole).alias(name(s, s + reach + 1))
            for s in range(n - reach)))
    moves = [F.array(*(F.first(name(s, k)) for k in range(s + 1, n + 1))) for s in range(n)]
    return rows.groupBy(*keys).agg(F.array(*moves).alias("moves"))


def longest_chains(events: DataFrame, steps: Sequence[str] = STEPS, bucket_seconds: int = 7 * DAY) -> DataFrame:
    """(user_id, item_id, depth, t_<step> ...): how many of ``steps`` the user took in order on the item, and when.

    The chain takes the first event of the first step, then always the first event of the next
    step that is strictly later, which reaches as deep as any choice and is earliest at every step.
    Steps not reached are null; pairs whose events are all of other actions give no row, those
    that never took the first step have depth 0.  Rows with a null are left out.  ``bucket_seconds`` only deals the work.
    """
    if len(set(steps)) != len(steps) or not steps:
        raise ValueError("steps are one or more different actions")
    n = len(steps)
    per_bucket = _transitions(events, steps, bucket_seconds * 1_000_000)
    # one row per bucket and pair, so the list is bounded by the time the log spans
    pairs = per_bucket.groupBy("user_id", "item_id").agg(F.array_sort(F.collect_list(F.struct("bucket", "moves"))).alias("parts"))
    times = F.aggregate(
        "parts", F.array().cast("array<bigint>"),
        lambda taken, part: F.when(F.size(taken) >= n, taken).otherwise(
            F.concat(taken, F.array_compact(F.coalesce(F.get(part["moves"], F.size(taken)), F.array().cast("array<bigint>"))))))
    time = lambda i: F.timestamp_micros(F.get("times", F.lit(i))).cast("timestamp_ntz")
    return pairs.select("user_id", "item_id", times.alias("times")).select(
        "user_id", "item_id", F.size("times").alias("depth"), *(time(i).alias(f"t_{s}") for i, s in enumerate(steps)))


def item_chain_funnel(chains: DataFrame, steps: Sequence[str] = STEPS) -> DataFrame:
    """Per item: users whose chain took each step, and the rates from step to step (null where none took the step before)."""
    per_item = chains.groupBy("item_id").agg(*(F.count(F.when(F.col("depth") > i, 1)).alias(s) for i, s in enumerate(steps)))
    return per_item.select("*", *(F.when(F.col(a) > 0, F.col(b) / F.col(a)).alias(f"{a}_to_{b}") for a, b in zip(steps, steps[1:])))
