"""Table maintenance and sinks: upserts, appends, segment exports, funnel tables.

Outputs go to the path that the caller gives, on storage all executors share.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from growthlens.operators import behavior as B
from growthlens.operators import funnel as FN


def upsert_items(current: DataFrame, incoming: DataFrame, key: str = "parent_asin",
                 order_col: str | None = None) -> DataFrame:
    """Insert-or-replace by key: an incoming row replaces the current one.

    Current rows without an incoming key pass through an anti join as they are;
    only ``incoming`` is deduplicated (the largest ``order_col`` wins, any row
    without one).  Rows with a NULL key match nothing and all stay.
    """
    cols = list(current.columns)
    keyed = incoming.where(F.col(key).isNotNull())
    if order_col:
        best = keyed.groupBy(key).agg(F.max(F.struct(F.col(order_col).alias("_ord"), *[c for c in cols if c != key])).alias("_w"))
        newest = best.select(key, "_w.*").select(*cols)
    else:
        newest = keyed.select(*cols).dropDuplicates([key])
    kept = current.join(newest.select(key), key, "left_anti").select(*cols)
    return kept.unionByName(newest).unionByName(incoming.where(F.col(key).isNull()).select(*cols))


def append_reviews(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Append a batch of reviews (columns matched by name; missing ones NULL)."""
    return current.unionByName(incoming, allowMissingColumns=True)


def export_segment_users_csv(spark: SparkSession, behavior: DataFrame, path: str, segment: str = "warm",
                             limit: int | None = None) -> str:
    """Write the user ids of a segment under ``path`` as CSV files with a ``user_id`` header; return ``path``."""
    users = B.segment_users(behavior, B.normalize_segment(segment), limit)
    users.write.mode("overwrite").option("header", True).csv(path)
    return path


def read_segment_export(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path).select(F.col("user_id").cast("bigint"))


def save_funnel_tables(spark: SparkSession, stage: DataFrame, path: str, mode: str = "both") -> dict[str, str]:
    """Materialise the loose / strict funnel tables as parquet and register views.

    ``mode='both'`` computes both variants in one aggregation and writes them
    once, partitioned by the 0/1 ``strict`` flag; the loose and strict views
    read their partition.  Views: ``item_funnel_features_loose`` / ``_strict``
    for what was built, ``item_funnel_features`` and ``_default`` on the chosen
    mode (loose when built), and ``item_funnel_features_both`` for ``both``.
    Returns table name -> written folder.
    """
    if mode not in ("both", "nonstrict", "strict"):
        raise ValueError("mode must be both, nonstrict or strict")
    written: dict[str, str] = {}
    views: dict[str, DataFrame] = {}
    if mode == "both":
        out = os.path.join(path, "item_funnel_features_both")
        FN.item_funnel_both(stage).write.mode("overwrite").partitionBy("strict").parquet(out)
        written["item_funnel_features_both"] = out
        both = spark.read.parquet(out)
        cols = [c for c in both.columns if c != "strict"]
        views["item_funnel_features_loose"] = both.where(F.col("strict") == 0).select(*cols)
        views["item_funnel_features_strict"] = both.where(F.col("strict") == 1).select(*cols)
        views["item_funnel_features_both"] = both.select("strict", *cols)
    else:
        name = "item_funnel_features_loose" if mode == "nonstrict" else "item_funnel_features_strict"
        out = os.path.join(path, name)
        FN.item_funnel(stage, strict=(mode == "strict")).write.mode("overwrite").parquet(out)
        written[name] = out
        views[name] = spark.read.parquet(out)
    default = views.get("item_funnel_features_loose", views.get("item_funnel_features_strict"))
    views["item_funnel_features"] = default
    views["item_funnel_features_default"] = default
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return written
