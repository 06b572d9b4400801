"""Batch retrieval: BM25, exact vector similarity, rank fusion, re-scoring, selection.

All queries of a batch are one plan. Queries are the side that is small by contract; they are broadcast up
to a checked number of rows and shuffled beyond. Ranks are cut per query before anything wide is joined.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import estimate_tokens, terms
from quern.operators.staging import bounded, staged

# Fixed values.
K1, B = 1.2, 0.75
RRF_K = 60
MODES = ("dense", "sparse", "hybrid", "hybrid+rerank")
#: Query rows (terms or vectors) up to this many are broadcast.
BROADCAST_ROWS = 200_000
#: Query vectors that go to every task, and vectors that meet them at once.
VECTOR_QUERIES, VECTORS = 10_000, 512
#: Queries whose terms make one matrix.
ASKED = 256
#: Terms of texts that are counted at once, unless one text has more.
TERMS = 1 << 18


@dataclass(frozen=True)
class SearchConfig:
    prefetch: int = 40
    candidates: int = 12
    top_k: int = 6
    min_score: float = -5.0
    context_tokens: int = 2500

    def __post_init__(self):
        if min(self.prefetch, self.candidates, self.top_k, self.context_tokens) < 1:
            raise ValueError("sizes are at least 1")


def few(df: DataFrame, rows: int | None) -> DataFrame:
    """Marked for broadcast where the caller knows that the rows are few enough."""
    return F.broadcast(df) if rows is not None and rows <= BROADCAST_ROWS else df


def postings(chunks: DataFrame, key: str = "id", text: str = "text", only: DataFrame | None = None) -> DataFrame:
    """(key, term, tf, len): a row for each distinct term of a text; `len` is the number of its terms.

    `only` (term) keeps the terms in it, before anything is shuffled where it is marked for broadcast. Without it each
    text is counted where it is read: no row a term is shuffled or held, but those of texts that share a key. Their keys are looked for at once.
    """
    t = chunks.select(F.col(key), terms(F.col(text)).alias("_t"))
    if only is not None:
        rows = t.select(key, F.size("_t").alias("len"), F.explode("_t").alias("term")).join(only, "term", "left_semi")
        return rows.groupBy(key, "len", "term").agg(F.count("*").alias("tf"))
    shared = staged(chunks.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n")).filter("_n > 1").select("_key"), "repeated")
    repeated = shared.count()
    kinds = f"`{key}` {dict(chunks.dtypes)[key]}, len int, term string, tf long"
    count = lambda rows: bounded(rows).mapInArrow(_counts_of_batches, kinds)
    if not repeated:
        return count(t)
    same = F.col(key).eqNullSafe(F.col("_key"))
    several = count(t.join(few(shared, repeated), same, "left_semi")).groupBy(key, "len", "term").agg(F.sum("tf").alias("tf"))
    return count(t.join(few(shared, repeated), same, "left_anti")).unionByName(several)


def _counts_of_batches(batches):
    """Of (key, terms): a row for each distinct term of a text, with the number of the text's terms and of its own places."""
    for batch in batches:
        size = pc.list_value_length(batch[1]).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size)
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - size[lo] + TERMS, "right")))
            coded = batch[1].slice(lo, hi - lo).flatten().dictionary_encode()
            names = max(1, len(coded.dictionary))
            pair, tf = np.unique(np.repeat(np.arange(lo, hi), size[lo:hi]) * names + coded.indices.to_numpy(), return_counts=True)
            of = pair // names
            made = [batch[0].take(pa.array(of)), pa.array(size[of].astype(np.int32)), coded.dictionary.take(pa.array(pair % names)), pa.array(tf.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(made, names=[batch.schema.names[0], "len", "term", "tf"])
            lo = hi


@dataclass(frozen=True)
class Counted:
    """What the texts have of the queries' terms: a written table of one row a text (key, len, at: places of its terms in `terms`, tf)."""

    table: DataFrame
    key: str
    terms: list[str]
    asked: list[tuple]  # (query_id, places of its terms)
    n: int
    avg_len: float
    df: np.ndarray

    def idf(self) -> np.ndarray:
        return np.log(1 + (self.n - self.df + 0.5) / (self.df + 0.5))

    def postings(self) -> DataFrame:
        """As `postings` gives them, of the queries' terms."""
        spark = self.table.sparkSession
        names = spark.createDataFrame(list(enumerate(self.terms)), "_at int, term string")
        rows = self.table.select(self.key, "len", F.inline(F.arrays_zip("at", "tf"))).withColumnRenamed("at", "_at")
        return rows.join(F.broadcast(names), "_at").select(self.key, "term", "tf", "len")


def counted(queries: DataFrame, chunks: DataFrame, key: str = "id", text: str = "text") -> Counted | None:
    """One reading of the texts for all that a batch of queries asks of them; None where the batch has more than BROADCAST_ROWS terms.

    The JVM makes the terms, numpy counts those of the queries.
    """
    asked = query_terms(queries, text="text").groupBy("query_id").agg(F.sort_array(F.collect_list("term")).alias("t")).limit(BROADCAST_ROWS + 1).collect()
    names = sorted({t for r in asked for t in r["t"]})
    if len(names) > BROADCAST_ROWS or len(asked) > BROADCAST_ROWS:
        return None
    kind = dict(chunks.dtypes)[key]
    shared = chunks.sparkSession.sparkContext.broadcast(names)

    def run(batches):
        wanted = pa.array(shared.value, pa.string())
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch["_t"]
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            at = pc.fill_null(pc.index_in(lists.flatten(), wanted), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            of = np.repeat(np.arange(batch.num_rows), size)[at >= 0]
            pair, tf = np.unique(of * len(wanted) + at[at >= 0], return_counts=True)
            ends = np.concatenate([[0], np.cumsum(np.bincount(pair // max(1, len(wanted)), minlength=batch.num_rows))]).astype(np.int32)
            made = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (pair % max(1, len(wanted)), tf)]
            yield pa.RecordBatch.from_arrays([batch[key], pa.array(size.astype(np.int32)), *made], names=[key, "len", "at", "tf"])

    made = bounded(chunks).select(F.col(key), terms(F.col(text)).alias("_t")).mapInArrow(run, f"`{key}` {kind}, len int, at array<int>, tf array<int>")
    table = staged(made, "postings")
    n, length = table.agg(F.count("*"), F.sum("len")).first()
    df = np.zeros(len(names), np.int64)
    for r in table.select(F.explode("at").alias("at")).groupBy("at").agg(F.count("*").alias("n")).collect():  # a row a term of the queries
        df[r["at"]] = r["n"]
    number = {t: i for i, t in enumerate(names)}
    return Counted(table, key, names, [(r["query_id"], [number[t] for t in r["t"]]) for r in asked], n, max(1.0, length / n) if n else 1.0, df)


def _bm25_of_batches(c: Counted, shared, limit: int, kind, places: int = 6):
    from pyspark.sql.pandas.types import to_arrow_type

    arrow, key, avg_len = to_arrow_type(kind), c.key, c.avg_len

    def run(batches):
        asked, idf = shared.value
        blocks = []
        for lo in range(0, len(asked), ASKED):
            own = asked[lo : lo + ASKED]
            used = np.unique(np.concatenate([np.array(t, np.int64) for _, t in own]))
            weight = np.zeros((len(used), len(own)))
            for j, (_, t) in enumerate(own):
                weight[np.searchsorted(used, t), j] = idf[t]
            blocks.append(([i for i, _ in own], used, weight))
        for batch in batches:
            for lo in range(0, batch.num_rows, VECTORS):
                part = batch.slice(lo, VECTORS)
                count = pc.list_value_length(part["at"]).to_numpy(zero_copy_only=False)
                at, tf = (part[x].flatten().to_numpy(zero_copy_only=False) for x in ("at", "tf"))
                of = np.repeat(np.arange(part.num_rows), count)
                ratio = part["len"].to_numpy(zero_copy_only=False) / avg_len
                value = tf * (K1 + 1) / (tf + K1 * (1 - B + B * ratio[of]))
                for ids, used, weight in blocks:
                    place = np.minimum(np.searchsorted(used, at), len(used) - 1)
                    own = used[place] == at
                    held = np.zeros((part.num_rows, len(used)))
                    held[of[own], place[own]] = value[own]
                    score = np.round((held @ weight).T, places)
                    # all that tie with the last of the best stay: ties are broken by key later
                    cut = np.partition(score, -limit, axis=1)[:, -limit] if part.num_rows > limit else np.zeros(len(ids))
                    # a text without a term of the query is no hit, whatever its score rounds to
                    q, j = np.nonzero((score >= cut[:, None]) & (score > 0))
                    yield pa.RecordBatch.from_arrays([pa.array(ids, arrow).take(pa.array(q)), part[key].take(pa.array(j)), pa.array(score[q, j])], names=["query_id", key, "score"])

    return run


def corpus_stats(chunks: DataFrame, text: str = "text") -> DataFrame:
    """One row: n (texts), avg_len (mean number of terms, at least 1; of no texts 1)."""
    return chunks.agg(F.count("*").alias("n"), F.greatest(F.coalesce(F.avg(F.size(terms(F.col(text)))), F.lit(1.0)), F.lit(1.0)).alias("avg_len"))


def document_frequency(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count("*").alias("df"))


def saturation(tf: Column, length: Column, avg_len: Column) -> Column:
    """The BM25 weight of a term in a text; a mean length of 0 or less counts as a ratio of 1."""
    ratio = F.when(avg_len <= 0, F.lit(1.0)).otherwise(length / avg_len)
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * ratio))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def query_terms(queries: DataFrame, key: str = "query_id", text: str = "text") -> DataFrame:
    """(query_id, term), each once."""
    return queries.select(F.col(key).alias("query_id"), F.explode(F.array_distinct(terms(F.col(text)))).alias("term"))


def ranked(df: DataFrame, score: str, tie: str, name: str, limit: int) -> DataFrame:
    """The `limit` best rows of each query, ranked from 1. Catalyst cuts groups before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy("query_id").orderBy(F.desc(score), tie)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= limit)


def bm25(queries: DataFrame, chunks: DataFrame, limit: int, post: DataFrame | Counted | None = None, key: str = "id", n_queries: int | None = None) -> DataFrame:
    """(query_id, key, score, sparse_rank): scores to 6 places, ties by key.

    Weights are made at query time from raw counts and the corpus' mean length, so they do not depend on
    the order in which texts were indexed. A query without terms has no rows. `post` may be given: the postings of an
    index, or what `counted` returns. Without postings a batch of texts is scored against all queries as one product
    of matrices, and passes on its own best `limit` a query only.
    """
    if post is None:
        post = counted(queries, chunks, key)
    if isinstance(post, Counted):
        kind = queries.schema["query_id"].dataType
        if not post.asked:
            return ranked(queries.limit(0).crossJoin(chunks.select(key).limit(0)).select("query_id", key, F.lit(0.0).alias("score")), "score", key, "sparse_rank", limit)
        shared = chunks.sparkSession.sparkContext.broadcast((post.asked, post.idf()))
        kinds = f"query_id {kind.simpleString()}, `{key}` {dict(chunks.dtypes)[key]}, score double"
        return ranked(bounded(post.table).mapInArrow(_bm25_of_batches(post, shared, limit, kind), kinds), "score", key, "sparse_rank", limit)
    wanted = few(query_terms(queries), n_queries and n_queries * 64)
    own = few(wanted.select("term").distinct(), n_queries and n_queries * 64)
    post = postings(chunks, key, only=own) if post is None else post.join(own, "term", "left_semi")
    hit = post.join(wanted, "term")
    df = document_frequency(post)
    weight = saturation(F.col("tf"), F.col("len"), F.col("avg_len")) * idf(F.col("n"), F.col("df"))
    scored = hit.join(df, "term").join(F.broadcast(corpus_stats(chunks))).groupBy("query_id", key).agg(F.round(F.sum(weight), 6).alias("score"))
    return ranked(scored, "score", key, "sparse_rank", limit)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0).cast("double"), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def nearest(queries: DataFrame, vectors: DataFrame, limit: int, key: str = "id", places: int = 6) -> DataFrame:
    """(query_id, key, score, dense_rank): exact cosine; `queries` (query_id, q) against every row of `vectors` (key, embedding).

    A stated query set against all rows, in blocks of about VECTOR_QUERIES queries that go to every task as one
    matrix; a batch of vectors passes on its own best `limit` a query only, so what is shuffled does not grow with
    the product. Queries whose dimension differs from a
    vector's do not meet it; a zero or null vector has a score of 0 or none.
    """
    held = queries.filter("q is not null").select("query_id", "q")
    kinds = f"query_id {dict(queries.dtypes)['query_id']}, `{key}` {dict(vectors.dtypes)[key]}, score double"
    blocks = held.count() // VECTOR_QUERIES + 1
    best = None
    for block in range(blocks):
        rows = held.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).collect() if blocks > 1 else held.collect()
        own = bounded(vectors).select(key, "embedding").mapInArrow(_best_of_batches([(r["query_id"], r["q"]) for r in rows], limit, places, held.schema["query_id"].dataType), kinds)
        best = own if best is None else best.unionByName(own)
    return ranked(best, "score", key, "dense_rank", limit)


def _best_of_batches(queries: list[tuple], limit: int, places: int, kind):
    from pyspark.sql.pandas.types import to_arrow_type

    by_size: dict[int, list[tuple]] = {}
    for i, q in queries:
        by_size.setdefault(len(q), []).append((i, q))
    matrices = {d: ([i for i, _ in own], _unit(np.array([q for _, q in own], np.float64).reshape(len(own), d))) for d, own in by_size.items()}
    arrow = to_arrow_type(kind)

    def run(batches):
        for batch in batches:
            key, vector = batch.schema.names
            lists = batch[vector]
            size = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
            for d, (ids, unit) in matrices.items():
                own = np.flatnonzero(size == d)
                for at in range(0, len(own), VECTORS):
                    part = own[at : at + VECTORS]
                    v = _unit(lists.take(pa.array(part)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), d))
                    score = np.round(unit @ v.T, places) + 0.0
                    # all that tie with the last of the best stay: ties are broken by key later
                    cut = np.partition(score, -limit, axis=1)[:, -limit] if len(part) > limit else np.full(len(ids), -np.inf)
                    q, j = np.nonzero(score >= cut[:, None])
                    yield pa.RecordBatch.from_arrays([pa.array(ids, arrow).take(pa.array(q)), batch[key].take(pa.array(part[j])), pa.array(score[q, j])], names=["query_id", key, "score"])

    return run


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def fuse(dense: DataFrame, sparse: DataFrame, limit: int, key: str = "id", k: int = RRF_K) -> DataFrame:
    """(query_id, key, rrf, fusion_rank) by reciprocal ranks over the union of both lists."""
    both = dense.select("query_id", key, F.col("dense_rank").alias("r")).unionByName(sparse.select("query_id", key, F.col("sparse_rank").alias("r")))
    summed = both.groupBy("query_id", key).agg(F.round(F.sum(1.0 / (k + F.col("r"))), 8).alias("rrf"))
    return ranked(summed, "rrf", key, "fusion_rank", limit)


def select_passages(hits: DataFrame, config: SearchConfig, threshold: bool, rank: str = "rank", tokens: str = "token_count") -> DataFrame:
    """What a reader gets of ranked hits: top_k, within the token budget, from the score threshold up.

    The first hit stays whatever its size; a first hit under the threshold means an empty result. Scores
    never increase along ranks, so stopping at the first miss is a filter on prefixes. A stored count of
    0 or null is estimated from the text.
    """
    cost = F.coalesce(F.nullif(F.col(tokens), F.lit(0)), estimate_tokens(F.col("text")) if "text" in hits.columns else F.lit(0))
    w = Window.partitionBy("query_id").orderBy(rank)
    used = F.sum("_cost").over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = hits.withColumn("_cost", cost).withColumn("cum_tokens", used).withColumn("_best", F.first("score").over(w))
    keep = (F.col(rank) <= config.top_k) & ((F.col(rank) == 1) | (F.col("cum_tokens") <= config.context_tokens))
    if threshold:
        keep &= (F.col("score") >= config.min_score) & (F.col("_best") >= config.min_score)
    return rows.filter(keep).drop("_cost", "_best")


def coverage(queries: DataFrame, hits: DataFrame, post: DataFrame | Counted, n_texts: int | None = None, key: str = "id", n_queries: int | None = None) -> DataFrame:
    """`hits` (query_id, key, ...) with `coverage`: sum of idf of matched query terms over that of all query terms, to 6 places.

    A deterministic stand-in for a cross-encoder. Terms that no text has weigh as if in none.
    """
    wanted = query_terms(queries)
    if isinstance(post, Counted):
        # what is known of the terms is at hand, and only the hits' own postings are read
        weights = hits.sparkSession.createDataFrame([(t, float(w)) for t, w in zip(post.terms, post.idf())], "term string, w double")
        weighed = wanted.join(F.broadcast(weights), "term")
        post = Counted(post.table.join(hits.select(key).distinct(), key, "left_semi"), key, post.terms, post.asked, post.n, post.avg_len, post.df).postings()
    else:
        df = document_frequency(post.join(few(wanted.select("term").distinct(), n_queries and n_queries * 64), "term", "left_semi"))
        weighed = wanted.join(df, "term", "left").withColumn("w", idf(F.lit(n_texts), F.coalesce("df", F.lit(0))))
    whole = weighed.groupBy("query_id").agg(F.sum("w").alias("whole"))
    part = hits.select("query_id", key).join(weighed, "query_id").join(post.select(key, "term"), [key, "term"]).groupBy("query_id", key).agg(F.sum("w").alias("part"))
    out = hits.join(part, ["query_id", key], "left").join(whole, "query_id", "left")
    return out.withColumn("coverage", F.round(F.coalesce(F.col("part") / F.col("whole"), F.lit(0.0)), 6)).drop("part", "whole")


def search(
    queries: DataFrame,
    chunks: DataFrame,
    mode: str = "hybrid+rerank",
    config: SearchConfig = SearchConfig(),
    vectors: DataFrame | None = None,
    embed: Callable[[Column], Column] | None = None,
    rerank: Callable[[DataFrame], DataFrame] | None = None,
    source: str | None = None,
    kind: str | None = None,
    key: str = "id",
) -> DataFrame:
    """Selected passages of each query: query_id, rank, key, score, token_count, cum_tokens.

    `queries` (query_id, text), `chunks` (key, text, token_count, source, kind), `vectors` (key, embedding). Filters
    apply before ranking. A single branch passes on `prefetch` candidates, a fused search `candidates`;
    a hybrid query without terms has its dense candidates only. `rerank` takes (query_id, key, query, text,
    fusion_rank) and adds `score`; ties keep the fused order. The threshold applies to re-scored searches.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    chunks = bounded(chunks)  # for embed and rerank too
    if source is not None:
        chunks = chunks.filter(F.col("source") == source)
    if kind is not None:
        chunks = chunks.filter(F.col("kind") == kind)
    sparse = bm25(queries, chunks, config.prefetch, key=key, n_queries=queries.count()) if mode != "dense" else None
    dense = None
    if mode != "sparse":
        if vectors is None or embed is None:
            raise ValueError("a dense search takes vectors and embed")
        dense = nearest(queries.select("query_id", embed(F.col("text")).alias("q")), vectors.join(chunks.select(key), key, "left_semi"), config.prefetch, key=key)
    if mode == "dense":
        hits = dense.withColumnRenamed("dense_rank", "rank")
    elif mode == "sparse":
        hits = sparse.withColumnRenamed("sparse_rank", "rank")
    else:
        hits = fuse(dense, sparse, config.candidates, key=key).select("query_id", key, F.col("rrf").alias("score"), F.col("fusion_rank").alias("rank"))
    hits = hits.join(chunks.select(key, "text", "token_count"), key)
    reranked = mode == "hybrid+rerank" and rerank is not None
    if reranked:
        asked = queries.select("query_id", F.col("text").alias("query"))
        scored = rerank(hits.drop("score").withColumnRenamed("rank", "fusion_rank").join(asked, "query_id"))
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "fusion_rank")
        hits = scored.withColumn("rank", F.row_number().over(w))
    return select_passages(hits, config, threshold=reranked).select("query_id", "rank", key, "score", "token_count", "cum_tokens")
