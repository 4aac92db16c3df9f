"""Incremental import of behavior files: each file once, lines that fail kept with the reason.

A file stream lists the folder, its checkpoint remembers which files are done,
and one run takes all that is new and ends.  Accepted and rejected lines go to one Parquet sink
whose log names the files of finished batches only, so a run that is
lost half way neither doubles nor drops lines when it is repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from growthlens.functions.columns import ACTIONS, strip_ws
from growthlens.sources.behavior_logs import CSV_FIELDS, _fields

#: Why a line is not imported, in the order in which it is looked at.
FEW_FIELDS, BAD_TIME, BAD_ACTION, NO_ID = "fewer than five fields", "time is no number", "unknown action", "no user or item"


def checked_lines(lines: DataFrame, delimiter: str = ",") -> DataFrame:
    """``lines(value, ...)`` with user_id, item_id, behavior, timestamp, category_id and ``reason`` (null: accepted).

    Fields are those of ``import_behavior_csv``; an empty user or item is a reason too.
    Blank lines and header lines (first field ``user_id``) go.
    """
    kept = [c for c in lines.columns if c != "value"]
    parts = lines.where(F.trim("value") != "").select("*", F.inline(F.array(F.struct(_fields(F.col("value"), delimiter).alias("f")))))
    text = {n: strip_ws(F.coalesce(F.col("f")[n], F.lit(""))) for n in CSV_FIELDS}
    number = text["timestamp"].try_cast("double")
    time_ok = F.coalesce(~F.isnan(number) & (F.abs(number) < F.lit(9.2e18)), F.lit(False))
    action = F.lower(text["behavior"])
    reason: Column = (
        F.when(F.col("f.timestamp").isNull(), FEW_FIELDS).when(~time_ok, BAD_TIME)
        .when(~action.isin(*ACTIONS), BAD_ACTION).when((text["user_id"] == "") | (text["item_id"] == ""), NO_ID))
    return parts.where(F.lower(text["user_id"]) != "user_id").select(
        *(f"`{c}`" for c in kept), "value", text["user_id"].alias("user_id"), text["item_id"].alias("item_id"), action.alias("behavior"),
        F.when(time_ok, number.cast("bigint")).alias("timestamp"), text["category_id"].alias("category_id"), reason.alias("reason"))


def import_new_files(spark: SparkSession, folder: str, store: str, delimiter: str = ",", max_files: int | None = None) -> None:
    """Import the files of ``folder`` that ``store`` has not seen yet; returns when they are done.

    Files are known by their path: one that is written again under its old name is not read again.  ``max_files`` bounds a
    batch, not the run.  ``folder`` and ``store`` lie on storage that driver and executors share.
    """
    reader = spark.readStream.option("maxFilesPerTrigger", max_files) if max_files else spark.readStream
    lines = reader.text(folder).select("value", F.col("_metadata.file_path").alias("file"))
    rows = checked_lines(lines, delimiter).withColumn("accepted", F.col("reason").isNull())
    run = (rows.writeStream.format("parquet").partitionBy("accepted").option("checkpointLocation", f"{store}/state")
           .option("path", f"{store}/lines").trigger(availableNow=True).start())
    run.awaitTermination()


def accepted_rows(spark: SparkSession, store: str) -> DataFrame:
    """(user_id, item_id, behavior, timestamp, category_id) of all lines imported so far."""
    return spark.read.parquet(f"{store}/lines").where("accepted = 'true'").select("user_id", "item_id", "behavior", "timestamp", "category_id")


def rejected_lines(spark: SparkSession, store: str) -> DataFrame:
    """(file, value, reason) of all lines that were not imported."""
    return spark.read.parquet(f"{store}/lines").where("accepted = 'false'").select("file", "value", "reason")
