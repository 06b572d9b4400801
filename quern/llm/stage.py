"""Written intermediate tables in the folder that the whole cluster shares.

A staged table cuts the lineage: a lost executor costs at most the tasks it was running, never the
steps before the table. Files are written and read by Spark alone, so any file system it knows will do.
"""

from __future__ import annotations

import ctypes
import gc
import time
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.staging import BATCH_BYTES, gone_at_exit, one_machine, shared_dir

#: Seconds that the cleaner of shuffle files, a thread of its own, is given.
CLEANED = 0.5

class Stage:
    """The written tables of one run of an operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.held: list[DataFrame] = []
        # what a Python worker is handed at once, in bytes: rows may be long
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
        self.root = gone_at_exit(spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")

    def write(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """Writes `df` as Parquet and returns the table read back. Columns without a type become strings.

        Where at most `rows` short rows are known to come, they go to one file for each million, behind a
        shuffle of their own: what makes them stays spread.
        """
        df = df.withColumns({c: df[c].cast("string") for c, kind in df.dtypes if kind == "void"})
        if rows is not None:
            df = df.repartition(rows // 1_000_000 + 1)
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def hold(self, df: DataFrame) -> DataFrame:
        """`df` kept on the executors' disks, for what is read again soon.

        A lost executor's part is computed again from the written tables that `df` comes from. `release` ends it.
        """
        self.held.append(df.persist(StorageLevel.DISK_ONLY))
        return self.held[-1]

    def release(self) -> None:
        """Lets go of all that is held."""
        while self.held:
            self.held.pop().unpersist()

    def free(self) -> None:
        """Has Spark remove the shuffle files of written tables, which it does when their plans are collected."""
        if one_machine(self.spark):
            return
        gc.collect()
        self.spark.range(1).collect()  # the scheduler holds on to the last job
        self.spark._jvm.System.gc()
        time.sleep(CLEANED)

    def drop(self, *names: str) -> None:
        """Deletes tables that no later step reads."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def tidy(run: Callable) -> Callable:
    """A function of Arrow batches that, at its end, gives what the task has freed back to the system: workers outlive their tasks."""

    def tidied(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # where the C library has it
            trim(0)

    return tidied


def parts(spark: SparkSession) -> int:
    """The number of partitions that the cluster is set to shuffle into."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(df: DataFrame, text: str) -> Column:
    """The text column as a string; null counts as empty."""
    return F.coalesce(df[text].cast("string"), F.lit(""))


def ordered(df: DataFrame, stage: Stage, name: str, *by: str) -> DataFrame:
    """`df` sorted by `by` over all partitions and written, with `pid` and the row number `at` in it.

    A range shuffle deals rows by sampled bounds, so equal work lands in every task whatever the keys are.
    The table is written before `pid` is used: a second evaluation could sample other bounds.
    """
    out = df.repartitionByRange(parts(df.sparkSession), *by).sortWithinPartitions(*by)
    out = out.withColumn("_mid", F.monotonically_increasing_id())
    out = stage.write(out, name)
    return out.withColumns({"pid": F.shiftright("_mid", 33), "at": F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_mid")


def small(df: DataFrame, limit: int) -> DataFrame:
    """`df`, a written table, marked for broadcast if it has at most `limit` rows; else as it is, for a shuffle."""
    return F.broadcast(df) if df.count() <= limit else df
