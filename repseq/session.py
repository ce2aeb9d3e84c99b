"""Session helpers that every layer shares."""

from __future__ import annotations

import ctypes
import math
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. One is made only where driver and executors
    are one process; elsewhere a missing setting is an error, since parts would be scattered over machines."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="repseq-checkpoint-"))
    return configured or sc._jsc.sc().getCheckpointDir().get()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's checkpoint folder."""
    shared_dir(spark)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and return the copy, which survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def few(df: DataFrame, most: int, each: int = 50_000) -> DataFrame:
    """``df``, known to have ``most`` rows or fewer, in one partition for each ``each`` of them, but one a core at least.

    A small table in many partitions costs a file and a task for each of them at every later exchange. Only partitions
    are merged; nothing is shuffled, and the rows are the same.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(most / each)))


def tasks(spark: SparkSession) -> int:
    """Tasks for stages whose work is far larger than their input, which adaptive execution would merge into one."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


#: Bytes of rows that Spark hands to a Python worker at once, about.
BATCH = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands rows to Python workers ``BATCH`` bytes at a time, whatever their number.

    Ten thousand texts at a time are kept by an executor several times over: in its buffers and in each worker.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < now <= BATCH:
        spark.conf.set(key, str(BATCH))


def give_back() -> None:
    """Returns memory that this Python worker has freed to the system, as workers stay while others need it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def given_back(batches: Iterator) -> Iterator:
    """``batches``, with the worker's free memory returned after the last one."""
    yield from batches
    give_back()


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan that gives fewer tasks than there are cores, dealt to all cores; larger scans stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Keys that hold at least this share of the rows are joined by broadcast: there are a thousand of them at most.
HOT = 1 / 1000


def join_counted(left: DataFrame, right: DataFrame, key: str, rows: str, total: int, how: str = "left") -> DataFrame:
    """``left`` joined with ``right``, which has one row per ``key`` and, in ``rows``, how many rows of ``left`` have that key.

    The keys with ``HOT`` of all ``total`` rows or more, a thousand at most, are broadcast, so their rows stay where they
    are; only the others are shuffled. ``rows`` is dropped.
    """
    hot = right.where(F.col(rows) >= total * HOT).drop(rows)
    rest = right.where(F.col(rows) < total * HOT).drop(rows)
    cold = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key, how)
    return left.join(F.broadcast(hot), key).unionByName(cold)
