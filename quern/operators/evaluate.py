"""Measures of retrieval over cases and modes: hit, recall, reciprocal rank, abstention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CASES = T.StructType().add("id", "string").add("question", "string").add("expected_sources", T.ArrayType(T.StringType())).add("tags", T.ArrayType(T.StringType()))


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a JSON Lines file; blank lines are skipped, a malformed line raises ValueError with path and line number.

    A set of cases is small by nature: its bad lines are found with one pass before anything uses it.
    """
    lines = spark.read.text(path, wholetext=False).withColumn("n", F.monotonically_increasing_id()).filter(F.trim("value") != "")
    parsed = lines.withColumn("case", F.from_json("value", T.StructType([*CASES.fields, T.StructField("_bad", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    lacks = F.col("case").isNull() | F.col("case._bad").isNotNull() | F.col("case.id").isNull() | F.col("case.question").isNull() | F.col("case.expected_sources").isNull()
    bad = parsed.filter(lacks).orderBy("n").select("n", "value").first()
    if bad:
        raise ValueError(f"{path}:{bad['n'] + 1} is no case: {bad['value'][:80]}")
    return parsed.select("case.id", "case.question", "case.expected_sources", F.coalesce("case.tags", F.array().cast("array<string>")).alias("tags"))


def outcomes(cases: DataFrame, retrieved: DataFrame) -> DataFrame:
    """A row per case and mode: hit, recall, reciprocal_rank, abstained, out_of_corpus.

    `cases` (case_id, mode, expected array), `retrieved` (case_id, mode, rank, source). Ranks count distinct
    sources in order of their first place.
    """
    first = retrieved.groupBy("case_id", "mode", "source").agg(F.min("rank").alias("rank"))
    place = first.withColumn("place", F.row_number().over(Window.partitionBy("case_id", "mode").orderBy("rank", "source")))
    wanted = cases.select("case_id", "mode", F.explode(F.array_distinct("expected")).alias("source"))
    found = place.join(wanted, ["case_id", "mode", "source"]).groupBy("case_id", "mode").agg(F.count("*").alias("found"), F.min("place").alias("best"))
    any_ = retrieved.select("case_id", "mode").distinct().withColumn("some", F.lit(True))
    out = cases.join(found, ["case_id", "mode"], "left").join(any_, ["case_id", "mode"], "left")
    size = F.size(F.array_distinct("expected"))
    return out.select(
        "case_id",
        "mode",
        F.coalesce(F.col("found") > 0, F.lit(False)).alias("hit"),
        F.when(size > 0, F.coalesce("found", F.lit(0)) / size).otherwise(0.0).alias("recall"),
        F.coalesce(1.0 / F.col("best"), F.lit(0.0)).alias("reciprocal_rank"),
        F.col("some").isNull().alias("abstained"),
        (size == 0).alias("out_of_corpus"),
    )


def _mean(x: Column, of: Column) -> Column:
    return F.coalesce(F.avg(F.when(of, x.cast("double"))), F.lit(0.0))


def report(results: DataFrame) -> DataFrame:
    """A row per mode; means over no case are 0."""
    inside, outside = ~F.col("out_of_corpus"), F.col("out_of_corpus")
    return results.groupBy("mode").agg(
        F.count("*").alias("cases"),
        F.round(_mean(F.col("hit"), inside), 6).alias("hit_rate"),
        F.round(_mean(F.col("recall"), inside), 6).alias("recall"),
        F.round(_mean(F.col("reciprocal_rank"), inside), 6).alias("mrr"),
        F.round(_mean(F.col("abstained"), outside), 6).alias("abstention_rate"),
        F.round(_mean(F.col("abstained"), inside), 6).alias("false_abstention_rate"),
    )


def failures(results: DataFrame) -> DataFrame:
    """Misses of answerable cases, and answers to cases that have none."""
    return results.filter((~F.col("out_of_corpus") & ~F.col("hit")) | (F.col("out_of_corpus") & ~F.col("abstained")))


def report_line(reports: DataFrame) -> DataFrame:
    percent = lambda c: F.col(c) * 100
    return reports.select("mode", F.format_string("%-14s hit %5.1f%%  recall %5.1f%%  mrr %.3f  abstains %5.1f%%  wrongly %5.1f%%", "mode", percent("hit_rate"), percent("recall"), "mrr", percent("abstention_rate"), percent("false_abstention_rate")).alias("line"))


#: Passages up to this many are broadcast.
BROADCAST_PASSAGES = 100_000
#: Words inside a passage by which it is looked for.
INSIDE = 6


def _marked(word: Column) -> Column:
    """One word in eight."""
    return F.pmod(F.xxhash64(word), F.lit(8)) == 0


def _windows(k: int, marked: bool) -> Column:
    """Hashes of runs of `k` words in `_w`: of all, or of those that begin with a marked word."""
    at = F.sequence(F.lit(1), F.size("_w") - k + 1)
    at = F.filter(at, lambda i: _marked(F.get("_w", i - 1))) if marked else at
    return F.transform(at, lambda i: F.xxhash64(F.slice("_w", i, k)))


def holders(texts: DataFrame, passages: DataFrame, n_passages: int, key: str = "doc_id") -> DataFrame:
    """(query_id, key): the texts (key, _t) that hold a passage (query_id, _q) as a string; both have single spaces between words.

    All but the first and last word of a passage stand in a text as words of their own. So texts and passages
    meet by the hash of a window of such words, and only those that meet are compared; passages of fewer than
    three words, if there are any, are held against every text. Passages are broadcast up to a checked number.
    """
    few = lambda t: F.broadcast(t) if n_passages <= BROADCAST_PASSAGES else t
    asked = passages.withColumn("_w", F.split("_q", " ")).withColumn("_k", F.least(F.size("_w") - 2, F.lit(INSIDE)))
    widths = sorted(r["_k"] for r in asked.filter("_q <> ''").select("_k").distinct().collect())  # at most INSIDE + 2 numbers
    found = []
    for k in (k for k in widths if k >= 1):
        # a passage's window is its first that begins with a marked word, so of a text only such windows are made
        inside = asked.filter(F.col("_k") == k).withColumn("_i", F.transform(F.sequence(F.lit(2), F.size("_w") - k), lambda i: F.when(_marked(F.get("_w", i - 1)), i)))
        inside = inside.withColumn("_i", F.array_compact("_i"))
        for marked in (True, False):
            own = inside.filter(F.size("_i") > 0) if marked else inside.filter(F.size("_i") == 0)
            if not marked and own.head(1) == []:
                continue
            own = own.select("query_id", F.xxhash64(F.slice("_w", F.get("_i", F.lit(0)) if marked else F.lit(2), F.lit(k))).alias("_h"))
            windows = texts.select(key, F.split("_t", " ").alias("_w")).filter(F.size("_w") >= k).select(key, F.explode(_windows(k, marked)).alias("_h"))
            near = windows.join(few(own), "_h").select(key, "query_id").distinct()
            found.append(texts.join(near, key).join(few(asked.select("query_id", "_q")), "query_id").filter(F.col("_t").contains(F.col("_q"))).select("query_id", key))
    if any(k < 1 for k in widths):
        short = asked.filter("_k < 1 and _q <> ''").select("query_id", "_q")
        found.append(texts.join(few(short), F.col("_t").contains(F.col("_q"))).select("query_id", key))
    empty = asked.filter("_q = ''").select("query_id")
    out = texts.select(key).join(few(empty)).select("query_id", key) if not found or empty.head(1) else None
    for f in found:
        out = f if out is None else out.unionByName(f)
    return out.distinct()
