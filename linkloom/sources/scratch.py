"""Intermediate tables in the folder that all executors share, and the size of what goes to Python."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Has Spark remove a job's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where that is unset, a temporary one is set in local mode only: on a
    cluster each executor would write to a disk of its own."""
    sc = spark.sparkContext
    there = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="linkloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that goes when the driver's Python ends."""
    path = f"{shared_dir(spark)}/linkloom/{name}"
    atexit.register(_quietly, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None:
        return
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Writes a table to the shared folder and reads it back: its lineage ends there and lost executors cost no rerun.

    The shuffle files of the job that wrote it go with its end. drop_table() removes the table early; what is left
    goes when the driver's Python ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    before = spark.conf.get(CLEANUP, None)
    try:
        spark.conf.set(CLEANUP, "true")
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


#: Bytes of an Arrow batch: a few thousand texts. Spark's default of 64 MB, doubled as buffers grow and held in both
#: processes of every task, is most of an executor's memory outside its heap.
BATCH_BYTES = 4 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """Has the session send texts to Python in small batches, unless it was told a smaller size; returns df."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(name, "64m").strip().lower()
    size = int(re.sub(r"[^0-9]", "", now)) * {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(now.rstrip("b")[-1:], 1)
    if not 0 < size <= BATCH_BYTES:
        conf.set(name, f"{BATCH_BYTES}b")
    return df


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of a table that was persisted and is no longer, which no job's end frees: it
    does so when their handles are collected, on the driver alone."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_table(df: DataFrame) -> None:
    if path := getattr(df, "_scratch", None):
        remove(df.sparkSession, path)


def _quietly(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the JVM may have ended first
        pass
