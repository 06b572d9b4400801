"""ingest, docs, search, ask, inspect, eval: one command a run. Exit codes: 0, 1 nothing found or failures, 2 an error."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.config import Settings
from quern.functions.text import excerpt, location
from quern.functions.vectors import hashed
from quern.operators import answer, evaluate, views
from quern.operators.chunk import chunk_sections
from quern.operators.index import IndexTable, summary
from quern.operators.retrieval import MODES, SearchConfig, search
from quern.sources import services
from quern.sources.corpus import files, load, load_corpus


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser("quern")
    commands = out.add_subparsers(dest="command", required=True)
    for name in ("ingest", "inspect"):
        commands.add_parser(name).add_argument("folder")
    commands.choices["ingest"].add_argument("--force", action="store_true")
    commands.choices["ingest"].add_argument("--reset", action="store_true")
    commands.add_parser("docs")
    for name in ("search", "ask", "eval"):
        sub = commands.add_parser(name)
        sub.add_argument("query" if name != "eval" else "cases")
        sub.add_argument("--mode", choices=MODES, default="hybrid")
        sub.add_argument("--top-k", type=int, default=6)
        sub.add_argument("--source")
    return out


def main(args: list[str] | None = None, spark: SparkSession | None = None, settings: Settings | None = None) -> int:
    asked = parser().parse_args(args)
    settings = settings or Settings.from_env()
    spark = spark or SparkSession.builder.appName("quern").getOrCreate()
    index = IndexTable(spark, settings.index)
    embed = services.embedder(settings.embed_url, settings.dimension) if settings.embed_url else hashed(settings.dimension)
    try:
        return globals()[f"run_{asked.command}"](asked, spark, settings, index, embed)
    except (OSError, ValueError, services.ServiceError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


def run_ingest(asked, spark, settings, index, embed) -> int:
    if asked.reset:
        index.drop()
    index.create(settings.dimension)
    report = index.sync(files(spark, asked.folder), embed, load, force=asked.force)
    for r in summary(report).orderBy("action").collect():
        print(f"{r['action']}: {r['sources']}")
    return int(report.filter("action = 'failed'").count() > 0)


def run_inspect(asked, spark, settings, index, embed) -> int:
    corpus = load_corpus(spark, asked.folder).persist()
    for k, v in views.inspect(chunk_sections(corpus.filter("error is null"))).first().asDict().items():
        print(f"{k}: {v}")
    failed = corpus.filter("error is not null").select("source", "error").collect()
    for r in failed:
        print(f"failed: {r['source']}: {r['error']}")
    return int(bool(failed))


def run_docs(asked, spark, settings, index, embed) -> int:
    rows = views.sources(index.chunks).collect()
    for r in rows:
        print(f"{r['chunks']:6} {r['source']}")
    return int(not rows)


def found(asked, queries: DataFrame, settings: Settings, index: IndexTable, embed) -> DataFrame:
    rerank = services.reranker(settings.rerank_url) if settings.rerank_url else None
    hits = search(queries, index.chunks, asked.mode, SearchConfig(top_k=asked.top_k), index.dense, embed, rerank, source=asked.source)
    return hits.drop("token_count").join(index.chunks, "id").withColumn("location", location(F.col("source"), F.col("page_start"), F.col("page_end"), F.col("heading_path")))


def one_query(spark: SparkSession, text: str) -> DataFrame:
    return views.valid_requests(spark.createDataFrame([("q", text, None, None, None)], "query_id string, query string, top_k int, history array<string>, mode string")).select("query_id", F.col("query").alias("text"))


def run_search(asked, spark, settings, index, embed) -> int:
    rows = found(asked, one_query(spark, asked.query), settings, index, embed).orderBy("rank").select("rank", "location", "score", excerpt(F.col("text"), 200).alias("text")).collect()
    for r in rows:
        print(f"[{r['rank']}] {r['location']} ({r['score']:.4f})\n    {r['text']}")
    return int(not rows)


def run_ask(asked, spark, settings, index, embed) -> int:
    queries = one_query(spark, asked.query)
    complete = services.completer(settings.llm_url, token=settings.llm_key or None) if settings.llm_url else answer.first_sentence
    passages = found(asked, queries, settings, index, embed).persist()
    got = answer.answers(answer.prompts(queries, passages), complete).first()
    print(got["text"] if got else answer.NO_CONTEXT_ANSWER)
    if not got or got["refused"]:
        return 1
    cited = answer.verify_citations(spark.createDataFrame([("q", got["text"])], "answer_id string, text string"), passages.withColumnRenamed("query_id", "answer_id"))
    for r in cited.orderBy("number").collect():
        print(f"[{r['number']}] {r['location'] if r['valid'] else 'no such passage'}")
    return 0


def run_eval(asked, spark, settings, index, embed) -> int:
    cases = evaluate.load_cases(spark, asked.cases)
    hits = found(asked, cases.select(F.col("id").alias("query_id"), F.col("question").alias("text")), settings, index, embed)
    results = evaluate.outcomes(
        cases.select(F.col("id").alias("case_id"), F.lit(asked.mode).alias("mode"), F.col("expected_sources").alias("expected")), hits.select(F.col("query_id").alias("case_id"), F.lit(asked.mode).alias("mode"), "rank", "source")
    ).persist()
    for r in evaluate.report_line(evaluate.report(results)).collect():
        print(r["line"])
    failed = evaluate.failures(results).orderBy("case_id").collect()
    for r in failed:
        print(f"failed: {r['case_id']}")
    return int(bool(failed))


if __name__ == "__main__":
    sys.exit(main())
