"""As-of join: each row of a fact table with the last row of a history table that began before it.

Both tables are put one under the other and shuffled once by key and time
bucket.  Inside a bucket the last history row is carried forward in order of
time; what a bucket inherits comes from a rollup of the history that has one
row per key and bucket.  No row is compared with more than its neighbours,
there is no cross product, and a key that holds a third of all rows lies in as
many tasks as it has buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400


def _micros(df: DataFrame, name: str):
    return F.unix_micros(F.col(name).cast("timestamp"))


def as_of_join(facts: DataFrame, history: DataFrame, on: list[str], fact_time: str, history_time: str, take: list[str],
               order_ties: list[str], bucket_seconds: int = 7 * DAY) -> DataFrame:
    """``facts`` (all rows and columns) with ``take`` of the last history row that has equal ``on`` and begins at or before them.

    Of history rows with equal time the one of largest ``order_ties`` counts.
    A null key or time on either side matches nothing: such facts keep nulls.
    ``bucket_seconds`` only deals the work; narrower buckets split hot keys further.
    """
    clash = set(take) & set(facts.columns)
    if clash:
        raise ValueError(f"columns to take are in the facts already: {sorted(clash)}")
    width = bucket_seconds * 1_000_000
    keys = [f"_k{i}" for i in range(len(on))]
    known = lambda df, time: df.where(" and ".join(f"`{c}` is not null" for c in [*on, time]))
    side = lambda df, time: [*(F.col(f"`{c}`").alias(k) for c, k in zip(on, keys)), _micros(df, time).alias("_t")]
    rules = known(history, history_time).select(
        *side(history, history_time), F.struct(*order_ties).alias("_tie"), F.struct(*take).alias("_taken"))
    rows = facts.select(F.struct(*[f"`{c}`" for c in facts.columns]).alias("_row"), *side(facts, fact_time))
    bucket = F.floor(F.col("_t") / width).cast("long").alias("_bucket")
    both = (
        rules.select(*keys, bucket, "_t", F.lit(0).alias("_kind"), "_tie", "_taken", F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"))
        .unionByName(rows.select(*keys, bucket, "_t", F.lit(1).alias("_kind"), F.lit(None).cast(rules.schema["_tie"].dataType).alias("_tie"),
                                 F.lit(None).cast(rules.schema["_taken"].dataType).alias("_taken"), "_row")))
    # facts without a key or a time meet nothing; a bucket of their own each spreads them
    alone = F.col("_t").isNull()
    for k in keys:
        alone = alone | F.col(k).isNull()
    both = both.withColumn("_bucket", F.when(alone, F.xxhash64("_row")).otherwise(F.col("_bucket")))
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_t", "_kind", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("_here", F.last("_taken", ignorenulls=True).over(inside)).where("_kind = 1")
    # one row per key and bucket of the history, and from which bucket on it counts
    rollup = rules.groupBy(*keys, bucket).agg(F.max_by("_taken", F.struct("_t", "_tie")).alias("_before"))
    until = F.lead("_bucket").over(Window.partitionBy(*keys).orderBy("_bucket"))
    spans = rollup.withColumn("_until", F.coalesce(until, F.lit(2**62)))
    # the buckets that facts lie in, each with the span that it inherits from
    wanted = rows.where(~alone).select(*keys, bucket).distinct()
    marks = spans.select(*keys, F.col("_bucket"), F.lit(0).alias("_kind"), "_before").unionByName(
        wanted.select(*keys, "_bucket", F.lit(-1).alias("_kind"), F.lit(None).cast(spans.schema["_before"].dataType).alias("_before")))
    # a bucket's own history comes after the mark, so the mark sees earlier buckets only
    seen = Window.partitionBy(*keys).orderBy("_bucket", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    inherits = marks.withColumn("_before", F.last("_before", ignorenulls=True).over(seen)).where("_kind = -1").select(*keys, "_bucket", "_before")
    joined = carried.join(inherits, [*keys, "_bucket"], "left")
    found = F.coalesce("_here", "_before")
    found = F.when(~alone, found)
    return joined.select("_row.*", *(found[c].alias(c) for c in take))


def commission_rate_as_of(orders: DataFrame, rules: DataFrame, on: tuple[str, ...] = ("merchant_id",), default_rate: str = "0.10",
                          bucket_seconds: int = 7 * DAY) -> DataFrame:
    """Each order's commission rate by the rule in force when it was placed.

    That is the rule of its key that began last on or before the order's date (of several on one date
    the highest id), if it has not ended: ``effective_to`` is the last day, null for ever.  An ended rule does not
    bring an older one back; the default rate holds then, as it does where no rule has begun.
    """
    rate = rules.schema["commission_rate"].dataType.simpleString()
    dated = orders.select(F.col("id").alias("order_id"), *on, F.to_date("ordered_at").alias("order_date"))
    history = rules.select(*on, "effective_from", F.col("id").alias("rule_id"), F.col("commission_rate").alias("rule_rate"), "effective_to")
    met = as_of_join(dated, history, list(on), "order_date", "effective_from", ["rule_id", "rule_rate", "effective_to"], ["rule_id"], bucket_seconds)
    holds = F.col("rule_id").isNotNull() & (F.col("effective_to").isNull() | (F.col("order_date") <= F.col("effective_to")))
    return met.select("order_id", *on, "order_date", F.when(holds, F.col("rule_id")).alias("rule_id"),
                      F.when(holds, F.col("rule_rate")).otherwise(F.lit(default_rate).cast(rate)).alias("commission_rate"))
