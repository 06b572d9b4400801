"""Queries over the given tables and their SQL.

The documents are the corpus, each one chunk of its own where chunking is not the matter; the benchmark
passages are the questions, `doc_id`s of documents that hold one (in lower case, single spaces) its answers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.operators import answer, evaluate, index, layout, retrieval, tabular, views
from quern.operators.chunk import prose_chunks
from quern.operators.retrieval import SearchConfig
from quern.operators.staging import bounded, spread, staged
from quern.sources.corpus import parse
from quern.streaming.ingest import event_windows

CONFIG = SearchConfig()
#: A re-scored hit below this coverage is no answer.
COVERAGE = 0.8

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def as_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text", "source", F.lit("prose").alias("kind"), X.estimate_tokens(text).alias("token_count"))


# SQL parts that several queries share
TERMS = f"""terms AS (SELECT doc_id, {X.strip_fold_terms_sql("text")} AS t FROM documents)"""
POST = f"""{TERMS}, post AS (SELECT doc_id, term, len, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM terms) GROUP BY ALL),
 df AS (SELECT term, count(*) AS df FROM post GROUP BY term), stats AS (SELECT count(*) AS n, greatest(coalesce(avg(len(t)), 1.0), 1.0) AS avg_len FROM terms),
 wanted AS (SELECT DISTINCT item_id AS query_id, unnest({X.strip_fold_terms_sql("text")}) AS term FROM benchmark)"""
IDF = "ln(1 + (n - df + 0.5) / (df + 0.5))"
WEIGHT = f"tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * (len / avg_len))) * {IDF}"
BM25 = f"""{POST}, scored AS (SELECT query_id, doc_id, round(sum({WEIGHT}), 6) AS score FROM wanted JOIN post USING (term) JOIN df USING (term), stats GROUP BY ALL),
 sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM scored QUALIFY r <= 40)"""
COVER = f"""{BM25}, weighed AS (SELECT query_id, term, ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) AS w FROM wanted LEFT JOIN df USING (term), stats),
 whole AS (SELECT query_id, sum(w) AS whole FROM weighed GROUP BY query_id),
 cover AS (SELECT s.query_id, s.doc_id, s.r, round(coalesce(sum(w), 0) / any_value(whole), 6) AS coverage FROM sparse s JOIN whole USING (query_id) LEFT JOIN (SELECT query_id, doc_id, w FROM weighed JOIN post USING (term)) m ON m.query_id = s.query_id AND m.doc_id = s.doc_id WHERE s.r <= 12 GROUP BY ALL)"""
TOKENS = "CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, round(length(text) / 3.0)) END::INTEGER"


@query(f"WITH {TERMS} SELECT term, count(*) AS n, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(t) AS term FROM terms) GROUP BY term")
def term_counts(spark, sf_dir):
    """Frequency and document frequency of every term."""
    post = retrieval.postings(docs(spark, sf_dir), "doc_id")
    return post.groupBy("term").agg(F.sum("tf").alias("n"), F.count("*").alias("df"))


@query(f"WITH {TERMS} SELECT doc_id, len(t)::INTEGER AS len, {TOKENS} AS tokens FROM terms JOIN documents USING (doc_id)")
def doc_lengths(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.size(X.terms(F.col("text"))).alias("len"), X.estimate_tokens(F.col("text")).alias("tokens"))


@query(f"WITH {TERMS} SELECT count(*) AS n, round(greatest(coalesce(avg(len(t)), 1.0), 1.0), 6) AS avg_len FROM terms")
def corpus_stats(spark, sf_dir):
    return retrieval.corpus_stats(docs(spark, sf_dir)).select("n", F.round("avg_len", 6).alias("avg_len"))


@query(f"WITH {POST} SELECT doc_id, term, round(tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * (len / avg_len))), 6) AS weight FROM post, stats")
def bm25_weights(spark, sf_dir):
    d = docs(spark, sf_dir)
    post = retrieval.postings(d, "doc_id").join(F.broadcast(retrieval.corpus_stats(d)))  # one row
    return post.select("doc_id", "term", F.round(retrieval.saturation(F.col("tf"), F.col("len"), F.col("avg_len")), 6).alias("weight"))


@query(f"WITH {BM25} SELECT query_id, doc_id, score, r::INTEGER AS sparse_rank FROM sparse WHERE r <= 12")
def bm25_topk(spark, sf_dir):
    q = questions(spark, sf_dir)
    return retrieval.bm25(q, docs(spark, sf_dir), CONFIG.candidates, key="doc_id", n_queries=q.count())


def vector_queries(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return v.filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), v.select(F.col("vec_id").alias("id"), "embedding", "label")


DOT = "list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[])"
DENSE = f"""dense AS (SELECT q.vec_id AS query_id, v.vec_id AS id, v.label, q.label AS own, round({DOT} / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[]))), 6) AS score,
 row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, v.vec_id) AS r FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 QUALIFY r <= 12)"""


@query(f"WITH {DENSE} SELECT query_id, id, score, r::INTEGER AS dense_rank FROM dense")
def dense_knn(spark, sf_dir):
    q, v = vector_queries(spark, sf_dir)
    return retrieval.nearest(q, v, CONFIG.candidates)


@query(f"WITH {DENSE} SELECT own AS label, count(*) AS pairs, round(avg((label = own)::INT), 6) AS purity FROM dense WHERE id <> query_id GROUP BY own")
def knn_label_purity(spark, sf_dir):
    q, v = vector_queries(spark, sf_dir)
    hits = retrieval.nearest(q, v, CONFIG.candidates).filter("id <> query_id")
    hits = hits.join(v.select("id", F.col("label").alias("found")), "id").join(v.select(F.col("id").alias("query_id"), "label"), "query_id")
    return hits.groupBy("label").agg(F.count("*").alias("pairs"), F.round(F.avg((F.col("found") == F.col("label")).cast("int")), 6).alias("purity"))


def second_list(sparse: DataFrame) -> DataFrame:
    """A list that ranks the same hits by id: stands in for a dense one, as the documents have no vectors."""
    return sparse.select("query_id", "doc_id", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id")).alias("dense_rank"))


FUSED = "fused AS (SELECT query_id, doc_id, round(1.0 / (60 + r) + 1.0 / (60 + row_number() OVER (PARTITION BY query_id ORDER BY doc_id)), 8) AS rrf FROM sparse), top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, doc_id) AS k FROM fused QUALIFY k <= 12)"


@query(f"WITH {BM25}, {FUSED} SELECT query_id, doc_id, rrf, k::INTEGER AS fusion_rank FROM top")
def rrf_fusion(spark, sf_dir):
    q = questions(spark, sf_dir)
    sparse = retrieval.bm25(q, docs(spark, sf_dir), CONFIG.prefetch, key="doc_id", n_queries=q.count())
    return retrieval.fuse(second_list(sparse), sparse, CONFIG.candidates, key="doc_id")


@query(f"WITH {BM25.replace('FROM documents', chr(70) + 'ROM (SELECT * FROM documents WHERE source = ' + chr(39) + 'src0' + chr(39) + ')', 1)} SELECT query_id, doc_id, score, r::INTEGER AS sparse_rank FROM sparse WHERE r <= 6")
def filtered_search(spark, sf_dir):
    """A filter by source reaches the scan and comes before ranks."""
    q = questions(spark, sf_dir)
    return retrieval.bm25(q, docs(spark, sf_dir).filter("source = 'src0'"), CONFIG.top_k, key="doc_id", n_queries=q.count())


def covered(spark, sf_dir):
    d, q = docs(spark, sf_dir), questions(spark, sf_dir)
    post = retrieval.counted(q, d, key="doc_id")
    if post is None:
        raise ValueError("more questions than one batch takes")
    hits = staged(retrieval.bm25(q, d, CONFIG.candidates, post=post, key="doc_id"), "hits")
    return staged(retrieval.coverage(q, hits, post, key="doc_id"), "covered")


@query(f"WITH {COVER} SELECT query_id, doc_id, coverage, r::INTEGER AS sparse_rank FROM cover")
def rerank_coverage(spark, sf_dir):
    return covered(spark, sf_dir).select("query_id", "doc_id", "coverage", "sparse_rank")


def answered(spark, sf_dir, hits=None):
    """Re-scored hits, selected: from coverage 0.8 up, within 2500 tokens, six at most."""
    w = Window.partitionBy("query_id").orderBy(F.desc("coverage"), "sparse_rank")
    hits = (covered(spark, sf_dir) if hits is None else hits).withColumn("rank", F.row_number().over(w)).drop("score").withColumnRenamed("coverage", "score")
    hits = hits.join(docs(spark, sf_dir).select("doc_id", X.estimate_tokens(F.col("text")).alias("token_count")), "doc_id")
    return retrieval.select_passages(hits, SearchConfig(min_score=COVERAGE), threshold=True)


SELECTED = f"""{COVER}, hits AS (SELECT query_id, doc_id, coverage AS score, {TOKENS} AS token_count, row_number() OVER (PARTITION BY query_id ORDER BY coverage DESC, r) AS rank FROM cover JOIN documents USING (doc_id)),
 run AS (SELECT *, sum(token_count) OVER (PARTITION BY query_id ORDER BY rank) AS cum_tokens, first(score) OVER (PARTITION BY query_id ORDER BY rank) AS best FROM hits),
 selected AS (SELECT * FROM run WHERE rank <= 6 AND (rank = 1 OR cum_tokens <= 2500) AND score >= 0.8 AND best >= 0.8)"""


@query(f"WITH {SELECTED} SELECT query_id, rank::INTEGER AS rank, doc_id, score, token_count, cum_tokens::BIGINT AS cum_tokens FROM selected")
def select_budget(spark, sf_dir):
    return answered(spark, sf_dir).select("query_id", "rank", "doc_id", "score", "token_count", "cum_tokens")


@query(f"WITH {SELECTED} SELECT item_id AS query_id FROM benchmark WHERE item_id NOT IN (SELECT query_id FROM selected)")
def abstained(spark, sf_dir):
    """Questions that get no passage."""
    return questions(spark, sf_dir).join(answered(spark, sf_dir), "query_id", "left_anti").select("query_id")


def gold(spark, sf_dir):
    """(query_id, expected): the documents that hold a question's passage. The questions are a stated set against all rows."""
    squash = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    q = questions(spark, sf_dir).select("query_id", squash("text").alias("_q"))
    d = docs(spark, sf_dir).select("doc_id", squash("text").alias("_t"))
    hit = evaluate.holders(d, q, q.count()).groupBy("query_id").agg(F.collect_set(F.col("doc_id").cast("string")).alias("expected"))
    return q.select("query_id").join(hit, "query_id", "left").select("query_id", F.coalesce("expected", F.array().cast("array<string>")).alias("expected"))


GOLD = r"""gold AS (SELECT item_id AS query_id, list(doc_id) FILTER (doc_id IS NOT NULL) AS expected FROM (SELECT item_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS q FROM benchmark) LEFT JOIN (SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t FROM documents) ON contains(t, q) GROUP BY item_id)"""
MEASURED = """places AS (SELECT mode, query_id, rank, doc_id FROM found), outcome AS (SELECT mode, g.query_id, len(coalesce(expected, [])) AS size, count(doc_id) FILTER (list_contains(expected, doc_id)) AS right_ones, min(rank) FILTER (list_contains(expected, doc_id)) AS best, count(doc_id) AS n_found
 FROM gold g CROSS JOIN (VALUES ('sparse'), ('sparse+rerank')) m(mode) LEFT JOIN places p USING (mode, query_id) GROUP BY mode, g.query_id, expected)
 SELECT mode, count(*) AS cases, round(coalesce(avg((right_ones > 0)::INT) FILTER (size > 0), 0), 6) AS hit_rate, round(coalesce(avg(right_ones / size) FILTER (size > 0), 0), 6) AS recall, round(coalesce(avg(coalesce(1.0 / best, 0)) FILTER (size > 0), 0), 6) AS mrr,
 round(coalesce(avg((n_found = 0)::INT) FILTER (size = 0), 0), 6) AS abstention_rate, round(coalesce(avg((n_found = 0)::INT) FILTER (size > 0), 0), 6) AS false_abstention_rate FROM outcome GROUP BY mode"""


@query(f"WITH {SELECTED}, found AS (SELECT 'sparse' AS mode, query_id, r AS rank, doc_id FROM sparse WHERE r <= 6 UNION ALL SELECT 'sparse+rerank', query_id, rank, doc_id FROM selected), {GOLD}, {MEASURED}")
def eval_by_mode(spark, sf_dir):
    """The flagship: all questions in both modes, measured against the documents that hold them, in one plan."""
    hits = covered(spark, sf_dir)
    found = hits.filter(F.col("sparse_rank") <= CONFIG.top_k).select("query_id", F.lit("sparse").alias("mode"), F.col("sparse_rank").alias("rank"), "doc_id")
    found = found.unionByName(answered(spark, sf_dir, hits).select("query_id", F.lit("sparse+rerank").alias("mode"), "rank", "doc_id"))
    found = found.select(F.col("query_id").alias("case_id"), "mode", "rank", F.col("doc_id").cast("string").alias("source"))
    cases = gold(spark, sf_dir).withColumn("mode", F.explode(F.array(F.lit("sparse"), F.lit("sparse+rerank")))).withColumnRenamed("query_id", "case_id")
    return evaluate.report(evaluate.outcomes(cases, found))


SENTENCES_SQL = r"""list_filter(list_transform(string_split(regexp_replace(text, '([.!?…])\s+([«"''(\[A-ZÀ-ÖØ-Þ0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: trim(s, ' ' || chr(10) || chr(9) || chr(13))), lambda s: s <> '')"""


@query(f"SELECT doc_id, len({SENTENCES_SQL})::INTEGER AS sentences, {TOKENS} AS tokens FROM documents")
def sentence_units(spark, sf_dir):
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", F.size(X.sentences(t)).alias("sentences"), X.estimate_tokens(t).alias("tokens"))


TOKENS_OF = "greatest(1, round(length({0}) / 3.0))"
TRIMMED = "list_filter(list_transform({0}, lambda y: trim(y, ' ' || chr(10) || chr(9) || chr(13))), lambda y: y <> '')"
# greedy runs of words of at most 400 tokens, which are 1201 characters
RUNS = r"list_reduce(list_transform(regexp_split_to_array({0}, '\s+'), lambda w: [w]), lambda a, b: CASE WHEN length(a[-1]) + 1 + length(b[1]) <= 1201 THEN list_append(a[:-2], a[-1] || ' ' || b[1]) ELSE list_concat(a, b) END)"
UNITS = f"""flatten(list_transform({TRIMMED.format(r"regexp_split_to_array(text, '\n{2,}')")}, lambda p: CASE WHEN {TOKENS_OF.format("p")} <= 400 THEN [p] ELSE flatten(list_transform({SENTENCES_SQL.replace("(text,", "(p,")}, lambda z: CASE WHEN {TOKENS_OF.format("z")} <= 400 THEN [z] ELSE {RUNS.format("z")} END)) END))"""
FOLD = rf"""units AS (SELECT doc_id, {UNITS} AS u FROM documents WHERE {TOKENS} > 692),
 folded AS (SELECT doc_id, list_reduce(list_transform(u, lambda x: {{'done': []::VARCHAR[][], 'run': [x]::VARCHAR[], 'n': greatest(1, round(length(x) / 3.0))::INTEGER}}),
  lambda s, x: CASE WHEN len(s.run) > 0 AND s.n + x.n > 400 THEN {{'done': list_append(s.done, s.run), 'run': list_append(s.run[len(s.run) + 1 - len(list_filter(list_transform(range(1, len(s.run) + 1), lambda i: list_sum(list_transform(s.run[i:], lambda y: greatest(1, round(length(y) / 3.0))))), lambda z: z <= least(60, 400 - x.n))):], x.run[1]),
   'n': (x.n + coalesce(list_sum(list_filter(list_transform(range(1, len(s.run) + 1), lambda i: CASE WHEN list_sum(list_transform(s.run[i:], lambda y: greatest(1, round(length(y) / 3.0)))) <= least(60, 400 - x.n) THEN greatest(1, round(length(s.run[i]) / 3.0)) ELSE 0 END), lambda z: z > 0)), 0))::INTEGER}}
  ELSE {{'done': s.done, 'run': list_append(s.run, x.run[1]), 'n': (s.n + x.n)::INTEGER}} END) AS s FROM units WHERE len(u) > 0),
 packs AS (SELECT doc_id, unnest(range(len(s.done) + 1)) AS i, list_append(s.done, s.run) AS p FROM folded),
 chunks AS (SELECT doc_id, i::INTEGER AS index, array_to_string(p[i + 1], chr(10) || chr(10)) AS text FROM packs UNION ALL SELECT doc_id, 0, text FROM documents WHERE {TOKENS} <= 692 AND regexp_matches(text, '\S'))"""


@query(f"WITH {FOLD} SELECT doc_id, index, sha256(text) AS text_sha256, {TOKENS} AS token_count FROM chunks")
def chunk_pack(spark, sf_dir):
    """Whole texts up to the maximum; else paragraphs, sentences and words packed into chunks of 400 tokens with an overlap of 60."""
    return prose_chunks(docs(spark, sf_dir)).select("doc_id", "index", F.sha2("text", 256).alias("text_sha256"), "token_count")


@query(f"WITH {FOLD} SELECT count(*) AS chunks, count(DISTINCT doc_id) AS documents, median({TOKENS})::DOUBLE AS median_tokens, round(avg({TOKENS}), 6) AS mean_tokens, max({TOKENS}) AS max_tokens FROM chunks")
def chunk_stats(spark, sf_dir):
    c = prose_chunks(docs(spark, sf_dir))
    return c.agg(F.count("*").alias("chunks"), F.count_distinct("doc_id").alias("documents"), F.percentile("token_count", F.lit(0.5)).alias("median_tokens"), F.round(F.avg("token_count"), 6).alias("mean_tokens"), F.max("token_count").alias("max_tokens"))


@query("""WITH h AS (SELECT doc_id, sha1(unhex('0b5f7a527d1e5f9a9c6e6f9f1a2b3c4d') || encode(sha256(coalesce(text, '')) || ':0')) AS h FROM documents)
 SELECT doc_id, concat(h[1:8], '-', h[9:12], '-5', h[14:16], '-', substr('89ab', (('0x' || h[17])::INTEGER % 4) + 1, 1), h[18:20], '-', h[21:32]) AS id FROM h""")
def chunk_ids(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.chunk_id(F.sha2(F.coalesce("text", F.lit("")), 256), F.lit(0)).alias("id"))


@query("""SELECT p_partkey::VARCHAR AS rec_id, concat_ws(chr(10), 'p_partkey : ' || p_partkey, 'p_name : ' || p_name, 'p_brand : ' || p_brand, 'p_type : ' || p_type, 'p_size : ' || p_size) AS text, 'part/' || p_partkey AS path, 'record' AS kind FROM part""")
def record_sections(spark, sf_dir):
    r = tabular.records(table(spark, sf_dir, "part"), ["p_partkey", "p_name", "p_brand", "p_type", "p_size"], "p_partkey", "part")
    return r.select("rec_id", "text", F.array_join("heading_path", "/").alias("path"), "kind")


@query("""WITH r AS (SELECT n_regionkey AS doc_key, 0 AS row_no, ['Code', 'Name', ''] AS cells FROM nation GROUP BY 1 UNION ALL SELECT n_regionkey, 1 + row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), ['N-' || n_nationkey, n_name, 'x'] FROM nation),
 c AS (SELECT a.doc_key, a.row_no, count(*) FILTER (b.cells[1] <> '' AND b.cells[2] <> '') AS score FROM r a JOIN r b ON a.doc_key = b.doc_key AND b.row_no > a.row_no WHERE a.row_no < 12 GROUP BY ALL HAVING score >= 2)
 SELECT doc_key, arg_max(row_no, score * 100 - row_no)::INTEGER AS header FROM c GROUP BY doc_key""")
def header_detect(spark, sf_dir):
    return tabular.headers(nation_rows(spark, sf_dir))


def nation_rows(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    place = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) + 1
    head = n.select(F.col("n_regionkey").alias("doc_key"), F.lit(0).alias("row_no"), F.array(F.lit("Code"), F.lit("Name"), F.lit("")).alias("cells")).distinct()
    return head.unionByName(n.select(F.col("n_regionkey").alias("doc_key"), place.alias("row_no"), F.array(F.concat(F.lit("N-"), "n_nationkey"), "n_name", F.lit("x")).alias("cells")))


LABELS = "['SKU', 'Kennung', 'Part no', 'Item name', 'Num']"


@query(f"""WITH r AS (SELECT DISTINCT n_regionkey AS doc_key, {LABELS}[n_regionkey + 1] AS label FROM nation),
 shaped AS (SELECT n_regionkey AS doc_key, bool_and(regexp_matches('N-' || n_nationkey, '^[A-Za-z]{{0,4}}[-_. ]?\\d+')) AND count(*) >= 2 AS ok FROM nation GROUP BY 1)
 SELECT doc_key, CASE WHEN regexp_matches(label, '{tabular.ID_LABEL}', 'i') THEN 2 ELSE 1 END AS id_column FROM r JOIN shaped USING (doc_key) WHERE ok""")
def id_column(spark, sf_dir):
    """A table a region, with names, codes and a third column under a label that names an id or doesn't."""
    n = table(spark, sf_dir, "nation")
    label = F.element_at(F.array(*[F.lit(x) for x in ("SKU", "Kennung", "Part no", "Item name", "Num")]), F.col("n_regionkey") + 1)
    cells = F.array(*[F.struct(F.lit(i).alias("column"), x.alias("label"), v.alias("value")) for i, (x, v) in enumerate([(F.lit("Name"), F.col("n_name")), (F.lit("Mark"), F.concat(F.lit("N-"), "n_nationkey")), (label, F.lit("x"))])])
    return tabular.id_columns(n.select(F.col("n_regionkey").alias("doc_key"), F.inline(cells)))


@query("SELECT source, count(*) AS chunks FROM documents GROUP BY source")
def sources_count(spark, sf_dir):
    return views.sources(docs(spark, sf_dir))


@query("SELECT source, count(*) AS chunks FROM documents GROUP BY ROLLUP (source)")
def sources_total(spark, sf_dir):
    return views.sources_total(docs(spark, sf_dir))


@query("SELECT source, min(sha256(text)) AS doc_sha256 FROM documents GROUP BY source")
def versions(spark, sf_dir):
    return views.versions(docs(spark, sf_dir).select("source", F.sha2("text", 256).alias("doc_sha256")))


@query("""WITH o AS (SELECT doc_id::VARCHAR AS source, sha256(text) AS old FROM documents WHERE doc_id % 7 <> 3), n AS (SELECT doc_id::VARCHAR AS source, sha256(CASE WHEN doc_id % 11 = 5 THEN text || '!' ELSE text END) AS new FROM documents WHERE doc_id % 13 <> 4)
 SELECT CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' WHEN old = new THEN 'unchanged' ELSE 'updated' END AS action, count(*) AS sources FROM o FULL JOIN n USING (source) GROUP BY 1""")
def sync_diff(spark, sf_dir):
    """A first and a second state of the corpus: some documents new, some gone, some changed."""
    d = docs(spark, sf_dir).select("doc_id", F.col("doc_id").cast("string").alias("source"), "text")
    old = d.filter("doc_id % 7 <> 3").select("source", F.sha2("text", 256).alias("sha256"))
    changed = F.when(F.col("doc_id") % 11 == 5, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return index.summary(index.diff(d.filter("doc_id % 13 <> 4").select("source", F.sha2(changed, 256).alias("sha256")), old))


def made_answers(spark, sf_dir):
    """Answers made from ids, as no table has citations: of four passages, one valid, one cited twice, one invented."""
    i = F.col("doc_id")
    text = F.concat(F.lit("First ["), i % 4 + 1, F.lit("], again ["), i % 4 + 1, F.lit("], then ["), i % 9, F.lit("] and ["), i % 50, F.lit("], not [123].")).alias("text")
    return docs(spark, sf_dir).select(i.alias("answer_id"), text)


@query(r"""WITH a AS (SELECT doc_id AS answer_id, list_transform(regexp_extract_all('First [' || (doc_id % 4 + 1) || '], again [' || (doc_id % 4 + 1) || '], then [' || (doc_id % 9) || '] and [' || (doc_id % 50) || '], not [123].', '\[(\d{1,2})\]', 1), lambda x: x::INTEGER) AS f FROM documents)
 SELECT answer_id, array_to_string(list_sort(list_distinct(list_filter(f, lambda x: x BETWEEN 1 AND 4))), ',') AS valid, array_to_string(list_filter(f, lambda x, i: x NOT BETWEEN 1 AND 4 AND list_position(f, x) = i), ',') AS invalid FROM a""")
def citations_extract(spark, sf_dir):
    valid, invalid = answer.citations(F.col("text"), F.lit(4))
    s = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return made_answers(spark, sf_dir).select("answer_id", s(valid).alias("valid"), s(invalid).alias("invalid"))


@query(r"""WITH a AS (SELECT DISTINCT doc_id AS answer_id, unnest(list_transform(regexp_extract_all('First [' || (doc_id % 4 + 1) || '], again [' || (doc_id % 4 + 1) || '], then [' || (doc_id % 9) || '] and [' || (doc_id % 50) || '], not [123].', '\[(\d{1,2})\]', 1), lambda x: x::INTEGER)) AS number FROM documents)
 SELECT number, number BETWEEN 1 AND 4 AS valid, count(*) AS answers FROM a GROUP BY ALL""")
def citations_verify(spark, sf_dir):
    made = made_answers(spark, sf_dir)
    passages = made.select("answer_id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("rank")).withColumns({"source": F.lit("s"), "location": F.lit("s, p. 1")})
    return answer.verify_citations(made, passages).groupBy("number", "valid").agg(F.count("*").alias("answers"))


PAIRS = "pairs AS (SELECT conv_id, turn, text AS question, left(nxt, 400) AS answer FROM (SELECT *, lead(text) OVER w AS nxt, lead(role) OVER w AS nrole FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nrole = 'assistant'), kept AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM pairs QUALIFY back <= 3)"


@query(f"WITH {PAIRS} SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INTEGER AS position, question, answer FROM kept")
def history_window(spark, sf_dir):
    return answer.history_window(table(spark, sf_dir, "conversations"))


LAST = "last AS (SELECT conv_id, arg_max(text, turn) AS question FROM conversations WHERE role = 'user' GROUP BY conv_id)"


@query(f"""WITH {PAIRS}, {LAST}, told AS (SELECT conv_id, string_agg('Question: ' || question || chr(10) || 'Answer: ' || answer, chr(10) ORDER BY turn) AS told FROM kept GROUP BY conv_id)
 SELECT conv_id, sha256('{answer.CONDENSE_PROMPT}' || chr(10) || chr(10) || told || chr(10) || 'Last question: ' || question) AS prompt_sha256 FROM told JOIN last USING (conv_id)""")
def followup_prompts(spark, sf_dir):
    """What a model is asked to rewrite the last question of each conversation."""
    turns = table(spark, sf_dir, "conversations")
    asked = answer.condense_prompt(answer.history_window(turns), last_questions(turns))
    return asked.select("conv_id", F.sha2("prompt", 256).alias("prompt_sha256"))


def last_questions(turns):
    return turns.filter("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("question"))


@query(f"""WITH {PAIRS}, {LAST}, said AS (SELECT conv_id, count(*) AS n, string_agg('user' || chr(10) || question || chr(10) || 'assistant' || chr(10) || answer || chr(10), '' ORDER BY turn) AS said FROM kept GROUP BY conv_id)
 SELECT conv_id, (2 + 2 * coalesce(n, 0))::INTEGER AS messages, sha256('system' || chr(10) || '{answer.SYSTEM_PROMPT}' || chr(10) || coalesce(said, '') || 'user' || chr(10) || '[1] (c)' || chr(10) || question || chr(10) || chr(10) || 'Question: ' || question || chr(10)) AS sha256 FROM last LEFT JOIN said USING (conv_id)""")
def chat_messages(spark, sf_dir):
    """The messages of each conversation's last question, with the exchanges before it; its own text is the one passage."""
    turns = table(spark, sf_dir, "conversations")
    q = last_questions(turns).select(F.col("conv_id").alias("query_id"), F.col("question").alias("text"))
    passages = q.select("query_id", F.lit(1).alias("rank"), F.lit("c").alias("location"), "text")
    made = answer.messages(answer.prompts(q, passages), answer.history_window(turns))
    said = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("\n"), m["content"], F.lit("\n"))), "")
    return made.select(F.col("query_id").alias("conv_id"), F.size("messages").alias("messages"), F.sha2(said, 256).alias("sha256"))


@query(f"""WITH {LAST} SELECT conv_id, CASE WHEN conv_id IN (SELECT conv_id FROM conversations c1 WHERE EXISTS (SELECT 1 FROM conversations c2 WHERE c2.conv_id = c1.conv_id AND c1.role = 'user' AND c2.role = 'assistant' AND c2.turn = (SELECT min(turn) FROM conversations c3 WHERE c3.conv_id = c1.conv_id AND c3.turn > c1.turn))) THEN 'rewritten' ELSE question END AS text FROM last""")
def followup_questions(spark, sf_dir):
    """Questions that have exchanges before them are rewritten, others stay; the model gives one line and more."""
    turns = table(spark, sf_dir, "conversations")
    return answer.standalone(turns, last_questions(turns), lambda system, prompt: F.concat(F.lit(" rewritten \nmore "), F.substring(prompt, 1, 0))).select("conv_id", "text")


@query(f"""WITH {SELECTED}, b AS (SELECT query_id, string_agg('[' || rank || '] (' || source || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context, count(*) AS n FROM selected JOIN documents USING (doc_id) GROUP BY query_id)
 SELECT item_id AS query_id, sha256(context || chr(10) || chr(10) || 'Question: ' || text) AS prompt_sha256, coalesce(n, 0)::INTEGER AS passages FROM benchmark LEFT JOIN b ON query_id = item_id""")
def prompt_context(spark, sf_dir):
    p = answered(spark, sf_dir).select("query_id", "rank", "doc_id").join(docs(spark, sf_dir).select("doc_id", F.col("source").alias("location"), "text"), "doc_id")
    return answer.prompts(questions(spark, sf_dir), p).select("query_id", F.sha2("prompt", 256).alias("prompt_sha256"), "passages")


@query(f"WITH {SELECTED} SELECT item_id NOT IN (SELECT query_id FROM selected) AS refused, count(*) AS answers FROM benchmark GROUP BY 1")
def answers(spark, sf_dir):
    """Questions answered by the stand-in model, or refused without it."""
    p = answered(spark, sf_dir).select("query_id", "rank", "doc_id").join(docs(spark, sf_dir).select("doc_id", F.col("source").alias("location"), "text"), "doc_id")
    made = answer.answers(answer.prompts(questions(spark, sf_dir), p), answer.first_sentence)
    return made.groupBy("refused").agg(F.count("*").alias("answers"))


@query()
def html_sections(spark, sf_dir):
    """Sections of the raw pages: the HTML loader over a table of pages."""
    from pyspark.sql import types as T

    schema = T.StructType().add("page_id", "long").add("pos", "integer").add("text", "string").add("path", "string").add("kind", "string")

    def run(frames):
        import pandas as pd

        for pdf in frames:
            rows = []
            for i, html in zip(pdf["page_id"], pdf["html"]):
                got = parse("page.html", (html or "").encode())
                rows += [(i, n, s["text"], " › ".join(s["heading_path"]), s["kind"]) for n, s in enumerate(got["sections"] or [])]
            yield pd.DataFrame(rows, columns=[f.name for f in schema])

    return bounded(table(spark, sf_dir, "pages")).select("page_id", "html").mapInPandas(run, schema)


def parsed(spark, table_, name, key, text, extension):
    """Rows of a table as files: parsed documents."""
    from quern.sources.corpus import load

    content = table_.select(F.concat(F.lit(f"{name}/"), F.col(key).cast("string"), F.lit(extension)).alias("source"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("content"))
    return load(content)


@query()
def page_chunks(spark, sf_dir):
    """The raw pages through loader and chunker."""
    from quern.operators.chunk import chunk_sections

    made = chunk_sections(parsed(spark, table(spark, sf_dir, "pages"), "pages", "page_id", "html", ".html").filter("error is null"))
    return made.select("id", "source", "index", "text", "token_count", F.array_join("heading_path", " › ").alias("path"), "kind")


@query()
def text_sections(spark, sf_dir):
    """The documents through the plain-text loader."""
    made = parsed(spark, docs(spark, sf_dir), "documents", "doc_id", "text", ".txt")
    return made.select("source", "title", F.posexplode_outer("sections").alias("pos", "s"), "error").select("source", "title", "pos", "s.text", F.array_join("s.heading_path", " › ").alias("path"), "error")


@query()
def hybrid_search(spark, sf_dir):
    """All questions in the full cascade: hashed vectors and BM25, fused, re-scored by a shared-word count, selected."""
    from quern.functions.vectors import hashed

    chunks, embed = as_chunks(spark, sf_dir), hashed(64)
    vectors = chunks.select("id", embed("text").alias("embedding"))

    def rerank(hits):
        a, b = X.terms(F.col("query")), X.terms(F.col("text"))
        return hits.withColumn("score", F.round(F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_distinct(a)), F.lit(1)), 6))

    return retrieval.search(questions(spark, sf_dir), chunks, "hybrid+rerank", SearchConfig(min_score=COVERAGE), vectors, embed, rerank)


ITEMS = "doc_key string, page int, y double, x double, x_end double, text string, kind string, size double, bold boolean"
# A two-page document in miniature: running heads, a large heading, a bold numbered one, body text.
ITEM_ROWS = [("d", p, y, 60.0, 300.0, t, "prose", s, b) for p in (1, 2, 3) for y, t, s, b in ((20.0, f"Manual page {p}", 8.0, False), (100.0, f"Part {p}", 18.0, False), (150.0, "A. Detail", 11.0, True), (200.0, "Body text " * 20, 11.0, False))]


def items(spark):
    return spark.createDataFrame(ITEM_ROWS, ITEMS)


VALUES = ", ".join(f"('d', {p}, {y}, {x}, {e}, '{t}', '{k}', {s}, {b})" for _, p, y, x, e, t, k, s, b in ITEM_ROWS)
ITEMS_SQL = f"items(doc_key, page, y, x, x_end, text, kind, size, bold) AS (VALUES {VALUES})"


@query(f"WITH {ITEMS_SQL} SELECT page, text FROM items WHERE NOT (y <= 64)")
def layout_running_heads(spark, sf_dir):
    pages = spark.createDataFrame([("d", p, 800.0, 3) for p in (1, 2, 3)], "doc_key string, page int, height double, pages int")
    return layout.drop_running_heads(items(spark), pages).select("page", "text")


@query(f"WITH {ITEMS_SQL} SELECT page, text, CASE WHEN size = 18 THEN 1 WHEN bold THEN 2 ELSE 0 END AS level FROM items")
def layout_headings(spark, sf_dir):
    return layout.mark_headings(items(spark)).select("page", "text", F.coalesce("level", F.lit(0)).alias("level"))


@query(f"WITH {ITEMS_SQL} SELECT (page - 1) AS pos, trim(text) AS text, 'Part ' || page || '/A. Detail' AS path, page AS page_start FROM items WHERE size = 11 AND NOT bold")
def layout_sections(spark, sf_dir):
    pages = spark.createDataFrame([("d", p, 800.0, 3) for p in (1, 2, 3)], "doc_key string, page int, height double, pages int")
    kept = layout.mark_headings(layout.drop_running_heads(items(spark), pages)).withColumn("pos", F.row_number().over(Window.partitionBy("doc_key", "page").orderBy("y", "x")))
    return layout.build_sections(kept).select("pos", F.trim("text").alias("text"), F.array_join("heading_path", "/").alias("path"), "page_start")


@query()
def layout_gutter(spark, sf_dir):
    """The gutter of a page of two columns of three lines."""
    words = [("d", 1, x + 30.0 * k, x + 30.0 * k + 26, 100.0 + 20 * n, 110.0 + 20 * n) for n in range(3) for x in (60.0, 320.0) for k in range(6)]
    lines = layout.word_lines(spark.createDataFrame(words, "doc_key string, page int, x double, x_end double, top double, bottom double"))
    return layout.gutters(lines, spark.createDataFrame([("d", 1, 595.0)], "doc_key string, page int, width double"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_hourly(spark, sf_dir):
    return event_windows(table(spark, sf_dir, "events"))
