"""Spark session helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on: UTC wall clock for TIMESTAMP_NTZ <-> epoch
# conversions, and adaptive execution so shuffle partition counts, join
# strategies and skewed partitions are decided from runtime statistics.
_SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # coalesce small shuffle partitions to the advisory size instead of keeping
    # at least default-parallelism tasks (Spark's advice for shared clusters)
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}


def scale_profile(input_bytes: float, target_partition_bytes: int = 256 << 20,
                  max_split_bytes: int = 512 << 20) -> dict[str, str]:
    """Partitioning settings sized for an input volume (e.g. 100 TB -> ~400k partitions).

    Shuffle partitions start at input / 256 MiB so that, with partial
    aggregation and compression, a reducer's share fits comfortably in an
    executor's memory; adaptive execution then coalesces small partitions and
    splits skewed ones.  File splits stay at 512 MiB.
    """
    parts = max(200, int(input_bytes // target_partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(2 * target_partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(max_split_bytes),
    }


def get_spark(app: str = "growthlens", master: str | None = None,
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Return the active session or build one.

    On a cluster ``master`` stays ``None`` and the launcher decides (pass
    ``extra=scale_profile(input_bytes)`` to size partitions); tests and the
    benchmark pass ``local[N]``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(_SESSION_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder used to cut lineage (``spark.checkpoint.dir``).

    The cluster names it.  Only a local-mode session without one (tests) gets
    a private folder; on a cluster a missing setting is an error, since a
    machine-local folder is not visible to other executors.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 -- sessions without a driver-side context
        sc = None
    if not configured and sc is not None:
        configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        master = sc.master if sc is not None else ""
        if not master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        # local runs (tests) only: a private folder on this machine
        configured = sc.getCheckpointDir() or tempfile.mkdtemp(prefix="growthlens-ckpt-")
    if sc is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured


def settle(df):
    """``df`` written once to the shared checkpoint folder and read from there by everything built on it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written tables."""
    return os.path.join(checkpoint_dir(spark), name)
