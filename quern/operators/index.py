"""An index of chunks as immutable Parquet versions under one folder, and its synchronisation with sources.

A version is written whole and then named in a pointer file, so readers see the old one or the new one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.staging import staged
from quern.operators.chunk import CHUNK, ChunkConfig, chunk_sections
from quern.operators.retrieval import postings

ACTIONS = ("added", "updated", "unchanged", "removed", "failed")


def diff(current: DataFrame, indexed: DataFrame) -> DataFrame:
    """(source, action, old, new) of two tables (source, sha256): a full outer join."""
    c, i = current.select("source", F.col("sha256").alias("new")), indexed.select("source", F.col("sha256").alias("old"))
    action = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "unchanged").otherwise("updated")
    return c.join(i, "source", "full").select("source", action.alias("action"), "old", "new")


def summary(changes: DataFrame) -> DataFrame:
    return changes.groupBy("action").agg(F.count("*").alias("sources"))


class IndexTable:
    """`create`, `drop`, `exists`, `info`, `sync`, `upsert`, `delete_source`, `chunks`, `dense`, `postings`, `snapshot`."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _meta(self) -> dict | None:
        fs, p = self._fs("meta")
        if not fs.exists(p):
            return None
        return json.loads(self.spark.read.text(f"{self.path}/meta/*").orderBy(F.col("_metadata.file_name").desc()).first()["value"])

    def _point(self, meta: dict) -> None:
        """Names a version: pointers are files of rising names, written aside and renamed into place."""
        meta = meta | {"number": meta.get("number", 0) + 1}
        fs, aside = self._fs(f"pending-{uuid.uuid4().hex}")
        out = fs.create(aside)
        out.write(bytearray(json.dumps(meta).encode()))
        out.close()
        _, place = self._fs(f"meta/{meta['number']:012d}.json")
        fs.mkdirs(place.getParent())
        if not fs.rename(aside, place):
            raise RuntimeError("another writer was faster")

    def exists(self) -> bool:
        return self._meta() is not None

    def create(self, dimension: int) -> None:
        """Does nothing where there is an index of this dimension; of another it raises ValueError."""
        meta = self._meta()
        if meta is None:
            self._point({"dimension": dimension, "version": None})
        elif meta["dimension"] != dimension:
            raise ValueError(f"the index holds vectors of {meta['dimension']}, not {dimension}")

    def drop(self) -> None:
        fs, p = self._fs("")
        fs.delete(p, True)

    def info(self) -> dict:
        return self._meta() or {}

    def _read(self, name: str, schema: str) -> DataFrame:
        meta = self._meta()
        if meta is None or meta["version"] is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{meta['version']}/{name}")

    @property
    def chunks(self) -> DataFrame:
        return self._read("chunks", CHUNK)

    @property
    def dense(self) -> DataFrame:
        return self._read("dense", "id string, embedding array<float>")

    @property
    def postings(self) -> DataFrame:
        return self._read("postings", "id string, len int, term string, tf long")

    def count(self) -> int:
        return self.chunks.count()

    def versions(self) -> DataFrame:
        return self.chunks.groupBy("source").agg(F.min("doc_sha256").alias("sha256"))

    def _replace(self, chunks: DataFrame, dense: DataFrame, counts: DataFrame | None = None) -> None:
        """A new version. `counts`: the postings of these chunks, where they are at hand."""
        meta = self._meta()
        if meta is None:
            raise ValueError("no index here; create it first")
        version = f"v-{uuid.uuid4().hex}"
        at = f"{self.path}/{version}"
        # by source inside files, so that a filter on it skips row groups
        chunks.sortWithinPartitions("source", "index").write.parquet(f"{at}/chunks")
        written = self.spark.read.schema(CHUNK).parquet(f"{at}/chunks")
        checked = dense.withColumn("embedding", F.when(F.size("embedding") == meta["dimension"], F.col("embedding")).otherwise(F.raise_error(F.lit("a vector has another dimension than the index"))))
        checked.write.parquet(f"{at}/dense")
        (postings(written) if counts is None else counts).write.parquet(f"{at}/postings")
        self._point(meta | {"version": version})

    def upsert(self, chunks: DataFrame, dense: DataFrame) -> None:
        """New chunks and vectors (id, embedding) take the place of old ones of their ids."""
        ids = chunks.select("id")
        self._replace(self.chunks.join(ids, "id", "left_anti").unionByName(chunks), self.dense.join(ids, "id", "left_anti").unionByName(dense))

    def delete_source(self, source: str) -> None:
        gone = self.chunks.filter(F.col("source") == source).select("id")
        self._replace(self.chunks.filter(F.col("source") != source), self.dense.join(gone, "id", "left_anti"))

    def sync(self, content: DataFrame, embed: Callable[[Column], Column], parse: Callable[[DataFrame], DataFrame], config: ChunkConfig = ChunkConfig(), force: bool = False) -> DataFrame:
        """Brings the index to the state of `content` (source, sha256, content); returns (source, action, stale).

        Unchanged sources are left out before anything is parsed, unless `force`. A source that can't be
        parsed any more keeps its old chunks and is reported `failed` and `stale`.
        """
        changes = diff(content.select("source", "sha256"), self.versions()).persist()
        todo = changes.filter(F.col("action").isin(*(("added", "updated", "unchanged") if force else ("added", "updated")))).select("source")
        parsed = parse(content.join(todo, "source", "left_semi")).persist()
        failed = parsed.filter("error is not null").select("source")
        good = parsed.filter("error is null")
        removed = changes.filter("action = 'removed'").select("source")
        old = self.chunks.join(removed.unionByName(good.select("source")), "source", "left_anti")
        new = chunk_sections(good, config)
        vectors = new.select("id", embed(F.col("text")).cast("array<float>").alias("embedding"))
        kept = self.dense.join(old.select("id"), "id", "left_semi")
        out = changes.join(failed.withColumn("_failed", F.lit(True)), "source", "left").select(
            "source", F.when(F.col("_failed"), "failed").otherwise(F.col("action")).alias("action"), (F.coalesce("_failed", F.lit(False)) & F.col("old").isNotNull()).alias("stale")
        )
        report = staged(out, "sync")  # a row a source
        if report.head(1) if force else report.filter("action in ('added', 'updated', 'removed')").head(1):
            self._replace(old.unionByName(new), kept.unionByName(vectors))
        changes.unpersist()
        parsed.unpersist()
        return report

    def snapshot(self, path: str) -> None:
        """A copy of the current version as an index of its own."""
        meta = self._meta() or {"dimension": 0, "version": None}
        copy = IndexTable(self.spark, path)
        copy.create(meta["dimension"])
        copy._replace(self.chunks, self.dense, self.postings)
