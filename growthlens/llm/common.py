"""Shared Spark helpers of the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ROOT = str(Path(__file__).resolve().parents[2])
#: A side with at most this many narrow rows is sent to every executor; beyond it the join shuffles.
BROADCAST_ROWS = 400_000
#: ``bounded`` sends at most so many bytes of rows to every executor.
BROADCAST_BYTES = 16 << 20
#: Removes the shuffle files of a statement as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the input folder."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def prepare(spark: SparkSession, batch_rows: int = 1000) -> None:
    """Make this package importable in Python workers and bound their Arrow batches."""
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, env.get("PYTHONPATH", "")) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch_rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset (tests on one machine) a temporary folder is used.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if where:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(where)
        return where
    found = sc._jsc.sc().getCheckpointDir()
    if found.isEmpty():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="growthlens-llm-"))
        found = sc._jsc.sc().getCheckpointDir()
    return found.get()


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared checkpoint folder and read it from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table of the shared folder.

    Unlike a checkpoint it keeps nothing of the plan (constraints and
    partitionings multiply from round to round of a loop).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared folder that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _row_bytes(value: Column, kind: T.DataType) -> Column:
    """About the bytes of a value: eight for a number, the length of texts, the sum of nested ones."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, T.StructType):
        return sum((_row_bytes(value[f.name], f.dataType) for f in kind.fields), F.lit(16))
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.StructType, T.ArrayType)):
            inner = F.aggregate(value, F.lit(0).cast("long"), lambda s, x: s + _row_bytes(x, kind.elementType))
        else:
            inner = F.size(value) * 8
        return F.coalesce(inner, F.lit(0)) + 16
    return F.lit(8)


def bounded(df: DataFrame, limit: int | None = None) -> DataFrame:
    """``df`` (a written table) with a broadcast hint if all its rows together take at most ``limit`` bytes."""
    limit = BROADCAST_BYTES if limit is None else limit
    size = df.agg(F.sum(sum((_row_bytes(F.col(f.name), f.dataType) for f in df.schema.fields), F.lit(8)))).first()[0] or 0
    return F.broadcast(df) if size <= limit else df


def small(df: DataFrame, limit: int | None = None) -> DataFrame:
    """``df`` (a settled frame of narrow rows) with a broadcast hint if its counted rows are few."""
    limit = BROADCAST_ROWS if limit is None else limit
    return F.broadcast(df) if df.count() <= limit else df


def fold_of(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % parts


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected links: (node, component = smallest node reachable).

    Alternating large-star and small-star steps; each is a map-side combined
    minimum per node and a join back, so no node's neighbours are gathered and
    a hub is split by the adaptive skew join.  Ends when only stars are left.  Null ends and loops are dropped; no links give no rows.
    """
    edges = written(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where("u is not null and v is not null and u <> v").distinct()
    )
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        # large star: every larger neighbour, and the node itself, points at the smallest one
        edges = written(
            both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        )
        # small star: neighbours not above the node point at the smallest of them
        low = written(edges.groupBy("u").agg(F.min("v").alias("m")))
        edges = written(
            edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        )
        # done when only stars are left: one link for each node, and no node is both end and centre
        ends = edges.select("u", F.lit(1).alias("n")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("n")).distinct())
        if not ends.groupBy("u").agg(F.count("*").alias("c")).where("c > 1").head(1):
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
