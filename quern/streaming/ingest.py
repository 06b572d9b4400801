"""Sources and events as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.index import IndexTable
from quern.sources.corpus import load


def ingest_stream(spark: SparkSession, folder: str, index: IndexTable, embed: Callable[[Column], Column], checkpoint: str):
    """New and changed files of a folder go into the index as they come, exactly once a batch.

    A file stream does not tell of deletions: those are found by a batch `sync`.
    """
    stream = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    rows = stream.select(F.regexp_replace(F.col("path"), r"^[a-z]+:/+", "/").alias("source"), F.sha2("content", 256).alias("sha256"), "content")

    def write(batch: DataFrame, _: int) -> None:
        known = index.versions().select("source", "sha256").join(batch.select("source"), "source", "left_anti")
        index.sync(batch.unionByName(known.withColumn("content", F.lit(None).cast("binary"))), embed, load)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums a window and kind, of a stream or a table. An extra: no counterpart elsewhere."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
