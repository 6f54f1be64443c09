"""Helpers shared by every operator: table access, checkpoints, checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

#: Tables of at most this many bytes (by the optimizer's own statistics) may be broadcast.
BROADCAST_BYTES = 8 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One input table; columns are pruned and filters pushed down by the plans on top of it."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir of the session, else one of our own.

    The fallback is a local folder and is taken only where the setting is absent and all tasks run on this machine, as in tests.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        base = "file://" + os.path.join(tempfile.gettempdir(), "siftline-checkpoints")
        spark.conf.set("spark.checkpoint.dir", base)
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
        p = spark._jvm.org.apache.hadoop.fs.Path(sc.getCheckpointDir())  # this application's own subfolder
        p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return base


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder (survives the loss of executors; the application's subfolder is deleted when the driver ends)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of a plan, an upper bound for scans and what narrows them."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint only when the plan's size is known to be below the limit; else Spark picks a shuffled join."""
    return F.broadcast(df) if plan_bytes(df) <= limit else df


def broadcast_sized(df: DataFrame, size: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint for a DataFrame whose bytes were counted, if they are below the limit."""
    return F.broadcast(df) if size <= limit else df


def blank_to_null(c: Column) -> Column:
    """'' as null."""
    return F.when(c != "", c)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often body mentions it (keeps generated code small)."""
    return F.transform(F.array(value), body)[0]


def spread(df: DataFrame) -> DataFrame:
    """At least one partition per core, for costly work on inputs of a few large files; otherwise (and for streams) the input itself."""
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def running_before(df: DataFrame, by: str, order: list[str], values: dict[str, Column]) -> DataFrame:
    """df with, for each name of values, the sum of that value over the rows before it in its group `by`, however long a group is.

    Rows are range-partitioned by (by, order), summed within their partitions, and moved by the sums of the partitions
    before, of which there is one row per partition and group. order must tell the rows of a group apart.
    """
    rows = df.withColumns({f"_v_{n}": F.coalesce(v.cast("long"), F.lit(0)) for n, v in values.items()})
    rows = checkpoint(rows.repartitionByRange(by, *order).sortWithinPartitions(by, *order).withColumn("_pid", F.spark_partition_id()))
    local = W.partitionBy(by, "_pid").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    parts = W.partitionBy(by).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)  # one row per partition the group reaches into
    whole = rows.groupBy(by, "_pid").agg(*[F.sum(f"_v_{n}").alias(f"_w_{n}") for n in values])
    bases = whole.select(F.col(by).alias("_by"), F.col("_pid").alias("_at"), *[F.coalesce(F.sum(f"_w_{n}").over(parts), F.lit(0)).alias(f"_b_{n}") for n in values])
    here = rows.withColumns({f"_l_{n}": F.coalesce(F.sum(f"_v_{n}").over(local), F.lit(0)) for n in values})
    out = here.join(bases, here[by].eqNullSafe(bases["_by"]) & (here["_pid"] == bases["_at"]))
    return out.withColumns({n: F.col(f"_b_{n}") + F.col(f"_l_{n}") for n in values}).select(*df.columns, *values)


def head_of(spark: SparkSession, path: str, size: int = 4096) -> bytes:
    """The first bytes of a file, wherever it lies."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    f = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(f, size)))
    finally:
        f.close()


def is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()
