"""Mergeable sketches: per day and item, stored as binary, merged to any window.

A day's visitors of an item are one HyperLogLog sketch, its event values one
KLL sketch.  A window of N days merges N sketch rows of an item and does
not read the log again; a refresh replaces the rows of the touched days.

Errors: HyperLogLog with ``LG_K`` = 12 has a relative standard error of
1.6 % (exact to a few hundred); a KLL sketch with ``KLL_K`` = 400 returns a value whose rank
is off by at most 0.8 % of the rows with 99 % confidence, merges included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LG_K, KLL_K = 12, 400


def daily_sketches(log: DataFrame, day: str = "day", item: str = "item_id", user: str = "user_id", value: str = "value") -> DataFrame:
    """(day, item_id, events, users, vals): one row per day and item of the log; ``users`` and ``vals`` are binary sketches.

    Rows without a day or an item are left out; null users and values count as events only.  All aggregates are
    combined in every task before the shuffle, so a hot item sends one sketch a task.
    """
    return (log.where(F.col(day).isNotNull() & F.col(item).isNotNull())
            .groupBy(F.col(day).alias("day"), F.col(item).alias("item_id"))
            .agg(F.count("*").alias("events"), F.hll_sketch_agg(F.col(user).cast("long"), LG_K).alias("users"),
                 F.call_function("kll_sketch_agg_double", F.col(value).cast("double"), F.lit(KLL_K)).alias("vals")))


def window_estimates(sketches: DataFrame, as_of, days: int, quantiles: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """(item_id, events, users, q50, q95 ...) of the ``days`` days up to and with ``as_of``, from the sketch rows of those days."""
    last = F.lit(as_of).cast("date")
    merged = (sketches.where((F.col("day") > F.date_sub(last, days)) & (F.col("day") <= last))
              .groupBy("item_id").agg(F.sum("events").alias("events"), F.hll_union_agg("users").alias("users"),
                                      F.call_function("kll_merge_agg_double", F.col("vals")).alias("vals")))
    known = F.call_function("kll_sketch_get_n_double", F.col("vals")) > 0
    return merged.select("item_id", "events", F.hll_sketch_estimate("users").alias("users"), *(
        F.when(known, F.call_function("kll_sketch_get_quantile_double", F.col("vals"), F.lit(float(q)))).alias(f"q{round(q * 100)}") for q in quantiles))
