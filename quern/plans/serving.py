"""Queries over what is stored and what leaves: files made of rows, the index, views, checks of requests; with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quern.functions import text as X
from quern.operators import evaluate, views
from quern.operators.index import IndexTable
from quern.operators.staging import gone_at_exit, shared_dir
from quern.plans.queries import GOLD, SELECTED, TOKENS, answered, covered, docs, gold, parsed, query, questions, table


def sections_of(files):
    """(source, title, pos, path, kind, text) of parsed files."""
    s = files.select("source", "title", F.posexplode("sections").alias("pos", "s"))
    return s.select("source", "title", "pos", F.array_join("s.heading_path", "/").alias("path"), F.col("s.kind").alias("kind"), F.col("s.text").alias("text"))


def part_files(spark, sf_dir, line, head, extension):
    """A file for each brand: a head, then a line for each of its parts by key."""
    lines = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("line")))).alias("lines"))
    text = F.concat(head, F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit("\n"))
    return parsed(spark, lines.select("p_brand", text.alias("text")), "brand", "p_brand", "text", extension)


@query("""SELECT 'brand/' || p_brand || '.csv' AS source, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1)::INTEGER AS pos, 'record' AS kind,
 concat_ws(chr(10), 'Item no : P-' || p_partkey, 'Name : ' || p_name, 'Size : ' || p_size) AS text FROM part""")
def delimited_sections(spark, sf_dir):
    """The parts of each brand as a file with semicolons, through the delimited loader: a record a row under its header."""
    line = F.concat(F.lit("P-"), "p_partkey", F.lit(";"), "p_name", F.lit(";"), "p_size")
    files = part_files(spark, sf_dir, line, F.lit("Item no;Name;Size\n"), ".csv")
    return sections_of(files).select("source", "pos", "kind", "text")


@query("""SELECT 'brand/' || p_brand || '.md' AS source, p_brand AS title, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1)::INTEGER AS pos,
 p_brand || '/Part ' || p_partkey AS path, p_name || ' of *size* ' || p_size AS text FROM part""")
def markdown_sections(spark, sf_dir):
    """The parts of each brand as Markdown: a section a part. Headings lose their markup, blocks are slices of the source."""
    line = F.concat(F.lit("## Part **"), "p_partkey", F.lit("**\n\n"), "p_name", F.lit(" of *size* "), "p_size", F.lit("\n"))
    files = part_files(spark, sf_dir, line, F.concat(F.lit("# "), "p_brand", F.lit("\n\n")), ".md")
    return sections_of(files).select("source", "title", "pos", "path", "text")


@query("""SELECT 'brand/' || p_brand || '.html' AS source, p_brand AS title, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1)::INTEGER AS pos,
 p_brand || '/Part ' || p_partkey AS path, p_name || ' of size ' || p_size AS text FROM part""")
def page_sections(spark, sf_dir):
    """The same as HTML, with a script and a footer that are no content."""
    line = F.concat(F.lit("<h2>Part "), "p_partkey", F.lit("</h2><p>"), "p_name", F.lit(" of\n<b>size</b> "), "p_size", F.lit("</p><script>no()</script>"))
    head = F.concat(F.lit("<html><body><nav>menu</nav><h1>"), "p_brand", F.lit("</h1>\n"))
    return sections_of(part_files(spark, sf_dir, line, head, ".html")).select("source", "title", "pos", "path", "text")


def stored(spark, sf_dir):
    """Documents as stored chunks with vectors of one number each."""
    d = docs(spark, sf_dir)
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    chunks = d.select(
        X.chunk_id(sha, F.col("doc_id")).alias("id"), "source", F.lit(None).cast("string").alias("title"), sha.alias("doc_sha256"), F.col("doc_id").cast("int").alias("index"), "text",
        X.estimate_tokens(F.col("text")).alias("token_count"), F.array("lang").alias("heading_path"), F.lit("prose").alias("kind"), F.lit(None).cast("int").alias("page_start"), F.lit(None).cast("int").alias("page_end"),
    )
    return chunks, chunks.select("id", F.array(F.col("token_count").cast("float")).alias("embedding"))


def fresh_index(spark):
    index = IndexTable(spark, gone_at_exit(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"))
    index.create(1)
    return index


@query("""SELECT source, CASE WHEN source = 'src1' THEN 'other' ELSE lang END AS path, count(*) AS chunks, sum(len(text))::BIGINT AS chars FROM documents WHERE source <> 'src0' GROUP BY ALL""")
def index_upsert_delete(spark, sf_dir):
    """The index of all documents; then chunks of one source again under another heading, one source deleted, and the state copied."""
    from quern.operators.chunk import CHUNK

    index = fresh_index(spark)
    chunks, dense = stored(spark, sf_dir)
    names = [f.strip().split()[0] for f in CHUNK.split(",")] if isinstance(CHUNK, str) else CHUNK.fieldNames()
    chunks = chunks.select(*[c if c in chunks.columns else F.lit(None).alias(c) for c in names])
    index.upsert(chunks, dense)
    again = chunks.filter("source = 'src1'").withColumn("heading_path", F.array(F.lit("other")))
    index.upsert(again, dense.join(again.select("id"), "id", "left_semi"))
    index.delete_source("src0")
    copy = gone_at_exit(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}")
    index.snapshot(copy)
    held = IndexTable(spark, copy)
    out = held.chunks.join(held.dense, "id")  # every chunk has its vector
    return out.groupBy("source", F.array_join("heading_path", "/").alias("path")).agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"))


@query(f"""SELECT count(DISTINCT source) AS documents, count(*) AS chunks, count(*) AS prose, 0::BIGINT AS table, 0::BIGINT AS record, median({TOKENS})::DOUBLE AS median_tokens,
 round(avg({TOKENS}), 6) AS mean_tokens, max({TOKENS}) AS max_tokens, arg_max(doc_id, (length(text), doc_id)) AS longest FROM documents""".replace("AS table", 'AS "table"'))
def corpus_inspection(spark, sf_dir):
    return views.inspect(docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "source", "text", F.lit("prose").alias("kind"), X.estimate_tokens(F.col("text")).alias("token_count")))


@query("""WITH p AS (SELECT doc_id, source, lang, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 90 + 1 END AS a, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id % 90 + 1 + doc_id % 2 END AS b FROM documents)
 SELECT doc_id, round(doc_id / 7.0, 4) AS score, source || CASE WHEN a IS NULL THEN '' WHEN b IS NULL OR a = b THEN ', p. ' || a ELSE ', p. ' || a || '-' || b END || CASE WHEN doc_id % 5 = 0 THEN '' ELSE ' — ' || lang || ' › ' || source END AS location FROM p""")
def passage_views(spark, sf_dir):
    """Passages as they are shown, with pages and headings made of ids and columns."""
    i = F.col("doc_id")
    page = i % 90 + 1
    made = docs(spark, sf_dir).select(
        "doc_id", "source", (i / 7.0).alias("score"), F.when(i % 3 != 0, page).alias("page_start"), F.when(i % 4 != 0, page + i % 2).alias("page_end"),
        F.when(i % 5 != 0, F.array("lang", "source")).otherwise(F.array().cast("array<string>")).alias("heading_path"), F.lit("{}").alias("metadata"),
    )
    return views.passage_view(made).select("doc_id", "score", "location")


@query("""SELECT doc_id, CASE WHEN length(body) <= 80 THEN body ELSE rtrim(left(body, 79), ' ') || '…' END AS excerpt
 FROM (SELECT doc_id, regexp_replace(regexp_replace(CASE WHEN contains(text, chr(10) || chr(10)) THEN substr(text, strpos(text, chr(10) || chr(10)) + 2) ELSE text END, '[\\s\\x0B\\x1C-\\x1F\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g'), '^ | $', '', 'g') AS body FROM documents)""".replace("\\\\", "\\"))
def excerpts(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.excerpt(F.col("text"), 80).alias("excerpt"))


@query("""SELECT conv_id, turn FROM conversations WHERE length(text) BETWEEN 1 AND 2000 AND conv_id % 23 BETWEEN 1 AND 20 AND turn * 9 <= 20 AND conv_id % 6 <> 5""")
def valid_requests(spark, sf_dir):
    """Turns as requests, with sizes and modes made of their numbers: some are out of bounds."""
    modes = F.array(*[F.lit(m) for m in ("dense", "sparse", "hybrid", "hybrid+rerank")], F.lit(None).cast("string"), F.lit("no mode"))
    t = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.col("text").alias("query"), (F.col("conv_id") % 23).alias("top_k"), F.array_repeat(F.lit("x"), (F.col("turn") * 9).cast("int")).alias("history"),
        F.element_at(modes, (F.col("conv_id") % 6 + 1).cast("int")).alias("mode"),
    )
    return views.valid_requests(t).select("conv_id", "turn")


@query(f"""WITH {SELECTED}, {GOLD}, f AS (SELECT 'sparse' AS mode, query_id, doc_id FROM sparse WHERE r <= 6 UNION ALL SELECT 'sparse+rerank', query_id, doc_id FROM selected)
 SELECT mode, g.query_id AS case_id, count(doc_id) = 0 AS abstained, coalesce(len(any_value(expected)), 0) = 0 AS out_of_corpus FROM gold g CROSS JOIN (VALUES ('sparse'), ('sparse+rerank')) m(mode) LEFT JOIN f USING (mode, query_id)
 GROUP BY mode, g.query_id HAVING CASE WHEN coalesce(len(any_value(expected)), 0) = 0 THEN count(doc_id) > 0 ELSE count(doc_id) FILTER (list_contains(expected, doc_id)) = 0 END""")
def eval_failures(spark, sf_dir):
    """Cases that an evaluation reports one by one: misses, and answers that should not be."""
    hits = covered(spark, sf_dir)
    found = hits.filter("sparse_rank <= 6").select("query_id", F.lit("sparse").alias("mode"), F.col("sparse_rank").alias("rank"), "doc_id")
    found = found.unionByName(answered(spark, sf_dir, hits).select("query_id", F.lit("sparse+rerank").alias("mode"), "rank", "doc_id"))
    found = found.select(F.col("query_id").alias("case_id"), "mode", "rank", F.col("doc_id").cast("string").alias("source"))
    cases = gold(spark, sf_dir).withColumn("mode", F.explode(F.array(F.lit("sparse"), F.lit("sparse+rerank")))).withColumnRenamed("query_id", "case_id")
    return evaluate.failures(evaluate.outcomes(cases, found)).select("mode", "case_id", "abstained", "out_of_corpus")


@query("""WITH p AS (SELECT text, list_filter(string_split_regex(text, '\\n{2,}'), lambda x: regexp_matches(x, '\\S')) AS paras, doc_id FROM documents)
 SELECT doc_id, len(paras)::INTEGER AS paragraphs, len(regexp_extract_all(text, '\\S+'))::INTEGER AS words, upper(text) = text AND lower(text) <> text AS all_caps, len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '^\\s*([•▪◦o\\-–—*]|\\(?[0-9]+[.)]|[a-z][.)])\\s')))::INTEGER AS bullets FROM p""".replace("\\\\", "\\"))
def text_shapes(spark, sf_dir):
    """Paragraphs, words, lines that are bullets, and whether a text is in capitals."""
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", F.size(X.paragraphs(t)).alias("paragraphs"), X.word_count(t).alias("words"), X.is_all_caps(t).alias("all_caps"), F.size(F.filter(F.split(t, "\n"), X.is_bullet)).alias("bullets"))


@query("""SELECT page_id, NOT contains(regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1), '.') OR regexp_matches(regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1), '\\.(local|internal|localhost|lan|home\\.arpa)$') AS inside FROM pages""".replace("\\\\", "\\"))
def private_pages(spark, sf_dir):
    """Pages whose host is one of a private network."""
    return table(spark, sf_dir, "pages").select("page_id", X.is_private_endpoint(F.col("url")).alias("inside"))
