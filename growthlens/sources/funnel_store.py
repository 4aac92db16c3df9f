"""Bucketed store of funnel stages: one row per day, user and item, refreshed by day.

The table is partitioned by day, and bucketed and sorted by user and item
within each day, so bringing the days of a user and item together needs no
shuffle, now or on any later read.  Buckets are by both columns: a user or an
item with a third of the log is spread over all of them.  A refresh
rewrites the touched days alone and leaves the other partitions as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from growthlens.functions.columns import ACTIONS

KEYS = ("user_id", "item_id")
_MODE = "spark.sql.sources.partitionOverwriteMode"


def daily_stage(norm: DataFrame) -> DataFrame:
    """(user_id, item_id, pv_ts, fav_ts, cart_ts, buy_ts, day): earliest time of each action on each day.

    ``norm`` has user_id, item_id, action and ts in epoch seconds; days are those of UTC.
    """
    valid = norm.where(F.col("action").isin(*ACTIONS) & F.col("ts").isNotNull())
    return valid.groupBy(*KEYS, F.date_from_unix_date(F.floor(F.col("ts") / 86_400).cast("int")).alias("day")).agg(
        *(F.min(F.when(F.col("action") == a, F.col("ts"))).alias(f"{a}_ts") for a in ACTIONS)).select(
        *KEYS, *(f"{a}_ts" for a in ACTIONS), "day")


def create_store(norm: DataFrame, name: str, path: str, buckets: int = 64) -> None:
    """Write the daily stages of ``norm`` as table ``name`` under ``path``; a table of that name must not exist.

    One task writes a bucket of all days, so each day has one file per bucket.  Choose ``buckets`` so that a
    bucket of the whole log fits a task (log bytes / 256 MB, say).
    """
    (daily_stage(norm).repartition(buckets, *KEYS).write.partitionBy("day").bucketBy(buckets, *KEYS).sortBy(*KEYS)
     .option("path", path).format("parquet").saveAsTable(name))


def _buckets(spark: SparkSession, name: str) -> int:
    rows = spark.sql(f"DESCRIBE EXTENDED {name}").where("col_name = 'Num Buckets'").head(1)
    if not rows:
        raise ValueError(f"{name} is not bucketed")
    return int(rows[0]["data_type"])


def refresh_days(norm: DataFrame, name: str, days: Sequence) -> None:
    """Rewrite ``days`` (dates) of table ``name`` from ``norm``, the log with at least those days whole.

    What ``stage_of`` returns is then that of a full rebuild.  Each touched day also gets a row without
    user and item, which ``stage_of`` leaves out: the partition of a day that lost all its events would not be overwritten otherwise.
    """
    if not days:
        return
    spark = norm.sparkSession
    dates = [F.lit(d).cast("date") for d in sorted(set(days))]
    touched = spark.range(1).select(F.explode(F.array(*dates)).alias("day"))
    begin = [F.unix_date(d).cast("long") * 86_400 for d in dates]
    inside = F.lit(False)
    for b in begin:
        inside = inside | ((F.col("ts") >= b) & (F.col("ts") < b + 86_400))
    rows = daily_stage(norm.where(inside))
    empty = touched.select(*(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns if c != "day"), "day")
    out = rows.unionByName(empty).repartition(_buckets(spark, name), *KEYS)
    before = spark.conf.get(_MODE)
    spark.conf.set(_MODE, "dynamic")
    try:
        out.write.mode("overwrite").insertInto(name)
    finally:
        spark.conf.set(_MODE, before)


def stage_of(spark: SparkSession, name: str, first_day=None, last_day=None) -> DataFrame:
    """(user_id, item_id, pv_ts ...) over the store's days, or those from ``first_day`` to ``last_day``: other days are not read, and nothing is shuffled."""
    rows = spark.table(name).where("user_id is not null and item_id is not null")
    if first_day is not None:
        rows = rows.where(F.col("day") >= F.lit(first_day).cast("date"))
    if last_day is not None:
        rows = rows.where(F.col("day") <= F.lit(last_day).cast("date"))
    return rows.groupBy(*KEYS).agg(*(F.min(f"{a}_ts").alias(f"{a}_ts") for a in ACTIONS))
