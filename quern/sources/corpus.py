"""A folder of files as a table of documents.

The walk lists names with Hadoop's file system on the driver, as Spark's own listing leaves out names that
begin with an underscore; bytes are read in tasks, hashed there, and parsed only where they changed.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.chunk import SECTION
from quern.operators.staging import bounded
from quern.sources.loaders import LoaderError, loader_for, supported, suffix

IGNORED = (".", "~$")
DOCUMENT = f"source string, sha256 string, format string, title string, sections array<{SECTION}>, warnings array<string>, error string"


def walk(spark: SparkSession, root: str) -> list[tuple[str, str, int]]:
    """(path, source, bytes) of each file with a loader, by path; no part of a source begins with `.` or `~$`. Sources are NFC."""
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(top) or not fs.getFileStatus(top).isDirectory():
        raise FileNotFoundError(root)
    base = fs.getFileStatus(top).getPath().toUri().getPath().rstrip("/") + "/"
    files, out = fs.listFiles(top, True), []
    while files.hasNext():
        status = files.next()
        path = status.getPath()
        source = path.toUri().getPath()[len(base) :]
        if suffix(source) in supported() and not any(part.startswith(IGNORED) for part in source.split("/")):
            out.append((path.toString(), unicodedata.normalize("NFC", source), status.getLen()))
    return sorted(out)


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    for pdf in frames:
        content = []
        for path in pdf["path"]:
            store, place = fs.FileSystem.from_uri(path.replace("%", "%25").replace(" ", "%20")) if path.startswith("file:") else fs.FileSystem.from_uri(path)
            with store.open_input_stream(place) as f:
                content.append(f.read())
        yield pd.DataFrame({"source": pdf["source"], "content": content})


def files(spark: SparkSession, root: str) -> DataFrame:
    """(source, sha256, content) of the files under a folder; lazily read.

    Spark's reader takes all but empty files and names that begin with an underscore; those are read in tasks by Arrow.
    """
    found = walk(spark, root)
    schema = "source string, content binary"
    out = spark.createDataFrame([], schema)
    plain = [(p, s) for p, s, size in found if size and not s.rpartition("/")[2].startswith("_")]
    if plain:
        by_path = F.broadcast(spark.createDataFrame(plain, "path string, source string"))  # the walk's own list
        escaped = [re.sub(r"([\\\[\]{}*?])", r"\\\1", p) for p, _ in plain]
        out = spark.read.format("binaryFile").load(escaped).join(by_path, "path").select("source", "content")
    others = [(p, s) for p, s, size in found if not size or s.rpartition("/")[2].startswith("_")]
    if others:
        out = out.unionByName(spark.createDataFrame(others, "path string, source string").mapInPandas(_read, schema))
    return out.select("source", F.sha2("content", 256).alias("sha256"), "content")


def parse(source: str, content: bytes) -> dict:
    """One file; what goes wrong is in `error`."""
    name = source.rpartition("/")[2]
    out = {"source": source, "sha256": hashlib.sha256(content).hexdigest(), "format": None, "title": None, "sections": None, "warnings": [], "error": None}
    found = loader_for(name)
    if found is None:
        return out | {"error": f"no loader for {suffix(name) or 'a name without an extension'}"}
    kind, load = found
    try:
        stem = name[: len(name) - len(suffix(name))]
        got = load(content, stem, tabs=True) if suffix(name) == ".tsv" else load(content, stem)
    except (LoaderError, OSError, ValueError) as e:
        return out | {"format": kind, "error": str(e) or type(e).__name__}
    fields = ("text", "heading_path", "kind", "page_start", "page_end", "row", "sheet", "rec_id")
    sections = [{f: list(v) if isinstance(v := getattr(s, f), tuple) else v for f in fields} for s in got.sections]
    return out | {"format": kind, "title": got.title, "sections": sections, "warnings": got.warnings}


def load(content: DataFrame) -> DataFrame:
    """(source, content) as documents; a file that fails is a row with `error`, and stops nothing."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ("source", "sha256", "format", "title", "sections", "warnings", "error")]
        for pdf in frames:
            yield pd.DataFrame([parse(s, bytes(c)) for s, c in zip(pdf["source"], pdf["content"])], columns=names)

    return bounded(content).select("source", "content").mapInPandas(run, DOCUMENT)


def load_corpus(spark: SparkSession, root: str) -> DataFrame:
    return load(files(spark, root))
