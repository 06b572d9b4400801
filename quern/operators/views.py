"""Shapes in which results leave: passages, documents, health; and checks of what comes in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.text import location

QUERY_CHARS, TOP_K, HISTORY = 2000, 20, 20


def with_defaults(chunks: DataFrame) -> DataFrame:
    """Stored chunks with defaults for what may be missing."""
    defaults = {"kind": F.lit("prose"), "token_count": F.lit(0), "heading_path": F.array().cast("array<string>"), "text": F.lit(""), "source": F.lit("")}
    return chunks.withColumns({c: F.coalesce(F.col(c), d) if c in chunks.columns else d for c, d in defaults.items()})


def passage_view(passages: DataFrame) -> DataFrame:
    """A passage as it is shown: score to 4 places, location, without metadata."""
    spot = location(F.col("source"), F.col("page_start"), F.col("page_end"), F.col("heading_path"))
    return passages.withColumn("score", F.round("score", 4)).withColumn("location", spot).drop("metadata")


def search_response(selected: DataFrame) -> DataFrame:
    """A JSON document a query."""
    entry = F.struct("rank", "id", "score", "source", "location", "text")
    return selected.groupBy("query_id").agg(F.to_json(F.array_sort(F.collect_list(entry))).alias("passages"), F.count("*").alias("found"))


def ask_response(answered: DataFrame) -> DataFrame:
    return answered.select("query_id", F.to_json(F.struct("text", "refused", "citations", "invalid_citations")).alias("body"))


def sources(chunks: DataFrame) -> DataFrame:
    """Chunks a source, by source."""
    return chunks.groupBy("source").agg(F.count("*").alias("chunks")).orderBy("source")


def sources_total(chunks: DataFrame) -> DataFrame:
    """The same with a row of the total, whose source is null."""
    return chunks.rollup("source").agg(F.count("*").alias("chunks"))


def versions(chunks: DataFrame) -> DataFrame:
    """One version a source; of several the least, whatever the order of rows."""
    return chunks.groupBy("source").agg(F.min("doc_sha256").alias("doc_sha256"))


def health(probes: DataFrame) -> DataFrame:
    return probes.agg(F.when(F.coalesce(F.every("reachable"), F.lit(True)), "ok").otherwise("degraded").alias("status"), F.count("*").alias("services"))


def valid_requests(requests: DataFrame) -> DataFrame:
    """Requests that pass: a query of 1 to 2000 characters, top_k 1 to 20, at most 20 exchanges, a known mode."""
    from quern.operators.retrieval import MODES

    return requests.filter(F.length("query").between(1, QUERY_CHARS) & F.coalesce(F.col("top_k").between(1, TOP_K), F.lit(True)) & (F.coalesce(F.size("history"), F.lit(0)) <= HISTORY) & F.coalesce(F.col("mode").isin(*MODES), F.lit(True)))


def inspect(chunks: DataFrame) -> DataFrame:
    """Counts of kinds and the spread of token counts over a corpus of chunks."""
    kind = lambda k: F.count_if(F.col("kind") == k).alias(k)
    return chunks.agg(
        F.count_distinct("source").alias("documents"), F.count("*").alias("chunks"), kind("prose"), kind("table"), kind("record"),
        F.percentile("token_count", F.lit(0.5)).alias("median_tokens"), F.round(F.avg("token_count"), 6).alias("mean_tokens"), F.max("token_count").alias("max_tokens"),
        F.max_by("id", F.struct(F.length("text"), "id")).alias("longest"),
    )
