"""Written intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []

#: Bytes of an Arrow batch, in place of Spark's 10,000 rows of any length.
BATCH_BYTES = 4 << 20


def bounded(df: DataFrame) -> DataFrame:
    """`df` as it is; its session hands Python workers at most BATCH_BYTES at once from now on, as rows may be long."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def one_machine(spark: SparkSession) -> bool:
    """Whether driver and executors are one process."""
    return spark.conf.get("spark.master", "").split("[")[0] == "local"


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` where the cluster names one; on one machine alone (tests) else a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not one_machine(spark):
        raise ValueError("a cluster needs spark.checkpoint.dir: a folder of this machine is not seen by the others")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="quern-stage-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return f"file://{_local[0]}"


def gone_at_exit(spark: SparkSession, path: str) -> str:
    """`path`, which the driver deletes when it ends."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """`df` written and read back: what is read several times is made once, and a lost executor costs no step before it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    gone_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A table that is read in fewer tasks than there are cores, dealt to all of them; any other as it is.

    Only a table under some MB a core is ever shuffled for this, so its size is bounded by the cluster's.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
