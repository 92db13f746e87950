"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import sys
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from functools import reduce, wraps
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: What separates words: the ASCII white space that bytes.split() knows.
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only a session on one machine without that setting, as in tests, gets a folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        found = os.path.join(tempfile.gettempdir(), "checkpoints")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/scholium-{spark.sparkContext.applicationId}"


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back.

    The result has no lineage to recompute and survives lost executors; unlike an RDD
    checkpoint it is compressed, column-pruned and has statistics for the planner. It
    goes with discard(), or at the end of the application.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/{uuid.uuid4().hex}"
    if spark.sparkContext.applicationId not in _applications:
        _applications.add(spark.sparkContext.applicationId)
        atexit.register(_remove, spark, _folder(spark))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = path
    weakref.finalize(out, _paths.pop, id(out), None)
    return out


_applications: set[str] = set()
_paths: dict[int, str] = {}


def discard(*tables: DataFrame) -> None:
    """Deletes tables that cut() wrote; nothing that is still to run may read them."""
    for df in tables:
        if path := _paths.pop(id(df), None):
            _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is None or context._jsc.sc().isStopped():
        return
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def spread(df: DataFrame) -> DataFrame:
    """df over as many tasks as there are cores, if it is stored in fewer pieces; large tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker gets at a time in rows and bytes, however long texts are.

    The bounds are the same for all operators, so plans that run later than they are made
    find what they were made for.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8192")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run for mapInArrow, on a worker that gives its memory back when a task ends: workers stay for later tasks."""

    @wraps(run)
    def freed(batches: Iterator) -> Iterator:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            gc.collect()
            release()

    return freed


def release() -> None:
    """Gives free memory of this process back to the system."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def words(text: Column) -> Column:
    """Array of the maximal runs of characters other than ASCII white space; NULL gives none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def ranked(df: DataFrame, of: list[str], by: list[str], name: str = "rank") -> DataFrame:
    """Adds the gapless rank from 0 of each row among the rows with equal ``of``, in order of ``by``.

    A window over ``of`` would bring all rows of a hot key into one task. Here rows are
    range-partitioned by (of, by), so a hot key spreads over many tasks; only the counts
    of each (partition, key) pair meet in a window, at most one row for each partition
    and key. Equal rows get distinct ranks in any order.
    """
    placed = cut(
        df.repartitionByRange(*of, *by)
        .sortWithinPartitions(*of, *by)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_at", 33))
    )
    names = [*of, "_part"]
    runs = placed.groupBy(*[F.col(c).alias(f"_of{i}") for i, c in enumerate(names)]).agg(
        F.min("_at").alias("_first"), F.count("*").alias("_n")
    )
    earlier = W.partitionBy(*[f"_of{i}" for i in range(len(of))]).orderBy(f"_of{len(of)}").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    same = [F.col(c).eqNullSafe(F.col(f"_of{i}")) for i, c in enumerate(names)]
    return placed.join(runs, reduce(and_, same)).select(
        *df.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias(name)
    )
