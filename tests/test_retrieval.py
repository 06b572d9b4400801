import json
import random

import pytest
from pyspark.sql import functions as F
from quern.functions.vectors import hashed
from quern.operators import answer, evaluate, retrieval
from quern.operators.evaluate import holders
from quern.operators.retrieval import SearchConfig, bm25, coverage, fuse, nearest, postings, search, select_passages

CHUNKS = [("c1", "Clean the pump filter weekly", "a.md", "prose"), ("c2", "Error code E-07 means the pump is hot", "a.md", "prose"), ("c3", "The warranty lasts two years", "b.md", "record"), ("c4", "pump pump pump pump", "b.md", "prose")]


@pytest.fixture
def chunks(spark):
    return spark.createDataFrame(CHUNKS, "id string, text string, source string, kind string").withColumn("token_count", F.length("text"))


@pytest.fixture
def asked(spark):
    return spark.createDataFrame([(1, "E-07"), (2, "pump filter"), (3, "zzz"), (4, "?!")], "query_id int, text string")


def ids(df, rank="rank"):
    out = {}
    for r in df.orderBy("query_id", rank).collect():
        out.setdefault(r["query_id"], []).append(r["id"])
    return out


def test_saturation_and_length(spark):
    w = lambda tf, n: spark.range(1).select(retrieval.saturation(F.lit(tf), F.lit(n), F.lit(10.0))).first()[0]
    assert w(1, 10) < w(50, 10) < 3 * w(1, 10) and w(1, 100) < w(1, 5)
    assert retrieval.corpus_stats(spark.createDataFrame([], "text string")).first()["avg_len"] == 1.0
    assert retrieval.corpus_stats(spark.createDataFrame([("one two three",), ("fo ur",)], "text string")).first()["avg_len"] == 2.5


def test_modes_filters_and_degradation(spark, chunks, asked):
    embed = hashed(32)
    vectors = chunks.select("id", embed("text").alias("embedding"))
    assert ids(search(asked, chunks, "sparse")) == {1: ["c2"], 2: ["c1", "c4", "c2"]}
    dense = ids(search(asked, chunks, "dense", vectors=vectors, embed=embed))
    assert set(dense) == {1, 2, 3, 4} and dense[2][0] in ("c1", "c4")
    both = ids(search(asked, chunks, "hybrid", vectors=vectors, embed=embed))
    assert both[1][0] == "c2" and set(both[4]) == set(dense[4])
    assert ids(search(asked, chunks, "sparse", source="b.md", kind="prose")) == {2: ["c4"]}
    for wrong in (dict(mode="odd"), dict(mode="dense")):
        with pytest.raises(ValueError):
            search(asked, chunks, **wrong)
    assert ids(search(asked, chunks.limit(0), "sparse")) == {}


def test_rerank_orders_and_abstains(spark, chunks, asked):
    embed = hashed(32)
    vectors = chunks.select("id", embed("text").alias("embedding"))
    by = lambda df: df.withColumn("score", F.when(F.col("id") == "c3", 5.0).otherwise(-9.0).cast("double"))
    got = search(asked, chunks, vectors=vectors, embed=embed, rerank=by)
    assert set(ids(got).values().__iter__().__next__()) == {"c3"}
    none = search(asked, chunks, vectors=vectors, embed=embed, rerank=lambda df: df.withColumn("score", F.lit(-9.0)))
    assert none.count() == 0


def test_budget_and_first_hit(spark):
    hits = lambda *t: spark.createDataFrame([(1, i + 1, f"c{i}", 1.0 - i / 10, n, "x" * 30) for i, n in enumerate(t)], "query_id int, rank int, id string, score double, token_count int, text string")
    pick = lambda h, **c: ids(select_passages(h, SearchConfig(**c), threshold=True)).get(1, [])
    assert pick(hits(400, 400, 400), context_tokens=1000) == ["c0", "c1"]
    assert pick(hits(9000, 10), context_tokens=1000) == ["c0"]
    assert pick(hits(1, 1, 1), top_k=2) == ["c0", "c1"]
    assert pick(hits(1, 1, 1), min_score=0.85) == ["c0", "c1"] and pick(hits(1, 1), min_score=2.0) == []
    assert [r["cum_tokens"] for r in select_passages(hits(0, None), SearchConfig(), False).orderBy("rank").collect()] == [10, 20]
    with pytest.raises(ValueError):
        SearchConfig(top_k=0)


def test_nearest_ways_agree(spark, monkeypatch):
    import random

    rng = random.Random(1)
    v = spark.createDataFrame([(i, [rng.choice([-1.0, 0.0, 0.5]) for _ in range(4)]) for i in range(900)] + [(900, None), (901, [1.0])], "id long, embedding array<float>").repartition(3)
    q = spark.createDataFrame([(f"q{i}", [rng.choice([-1.0, 1.0, 0.25]) for _ in range(4)]) for i in range(9)] + [("none", None)], "query_id string, q array<float>")
    fast = sorted(map(tuple, nearest(q, v, 7).collect()))
    monkeypatch.setattr(retrieval, "VECTOR_QUERIES", 3)
    assert fast == sorted(map(tuple, nearest(q, v, 7).collect())) and len(fast) == 63
    assert nearest(q.limit(0), v, 7).count() == 0 and nearest(q, v.limit(0), 7).count() == 0


def test_nearest_fuse_coverage(spark, chunks, asked):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.6, 0.8]), ("z", [0.0, 0.0]), ("odd", [1.0])], "id string, embedding array<float>")
    q = spark.createDataFrame([(1, [2.0, 0.0])], "query_id int, q array<float>")
    assert [(r["id"], r["score"]) for r in nearest(q, v, 3).orderBy("dense_rank").collect()] == [("a", 1.0), ("b", 0.6), ("z", 0.0)]
    d = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id int, id string, dense_rank int")
    s = spark.createDataFrame([(1, "b", 1), (1, "c", 2)], "query_id int, id string, sparse_rank int")
    assert [(r["id"], r["rrf"]) for r in fuse(d, s, 9).orderBy("fusion_rank").collect()] == [("b", round(1 / 62 + 1 / 61, 8)), ("a", round(1 / 61, 8)), ("c", round(1 / 62, 8))]
    post = postings(chunks)
    got = {(r["query_id"], r["id"]): r["coverage"] for r in coverage(asked, bm25(asked, chunks, 5, post=post), post, 4).collect()}
    assert got[1, "c2"] == got[2, "c1"] == 1.0 and 0 < got[2, "c4"] < 1


def test_measures(spark, tmp_path):
    cases = spark.createDataFrame([("hit", ["a"]), ("second", ["b"]), ("half", ["a", "x"]), ("miss", ["q"]), ("out", []), ("wrong", [])], "case_id string, expected array<string>").withColumn("mode", F.lit("m"))
    found = spark.createDataFrame([("hit", 1, "a"), ("hit", 2, "a"), ("second", 1, "a"), ("second", 2, "a"), ("second", 3, "b"), ("half", 1, "z"), ("half", 2, "y"), ("half", 3, "a"), ("wrong", 1, "a")], "case_id string, rank int, source string").withColumn("mode", F.lit("m"))
    out = evaluate.outcomes(cases, found)
    got = {r["case_id"]: (r["hit"], r["recall"], round(r["reciprocal_rank"], 3), r["abstained"]) for r in out.collect()}
    assert got == {"hit": (True, 1.0, 1.0, False), "second": (True, 1.0, 0.5, False), "half": (True, 0.5, 0.333, False), "miss": (False, 0.0, 0.0, True), "out": (False, 0.0, 0.0, True), "wrong": (False, 0.0, 0.0, False)}
    r = evaluate.report(out).first()
    assert (r["hit_rate"], r["recall"], r["mrr"], r["abstention_rate"], r["false_abstention_rate"]) == (0.75, 0.625, round((1 + 0.5 + 1 / 3) / 4, 6), 0.5, 0.25)
    assert {x["case_id"] for x in evaluate.failures(out).collect()} == {"miss", "wrong"} and "75.0%" in evaluate.report_line(evaluate.report(out)).first()["line"]
    path = tmp_path / "cases.jsonl"
    path.write_text(json.dumps({"id": "1", "question": "q", "expected_sources": ["a"], "tags": ["t"]}) + "\n\n" + json.dumps({"id": "2", "question": "r", "expected_sources": []}) + "\n")
    assert [(c["id"], c["tags"]) for c in evaluate.load_cases(spark, str(path)).orderBy("id").collect()] == [("1", ["t"]), ("2", [])]
    path.write_text('{"id": "1", "question": "q", "expected_sources": []}\nnot json\n')
    with pytest.raises(ValueError, match=":2 "):
        evaluate.load_cases(spark, str(path))


def test_answers_and_citations(spark):
    a = spark.createDataFrame([(1, "See [2] and [1], [2]; not [0], [9], [123]."), (2, "none")], "answer_id int, text string")
    valid, invalid = answer.citations(F.col("text"), F.lit(3))
    assert [tuple(r) for r in a.select(valid, invalid).collect()] == [([1, 2], [0, 9]), ([], [])]
    p = spark.createDataFrame([(1, 1, "a.md", "a.md, p. 1"), (1, 2, "b.md", "b.md")], "answer_id int, rank int, source string, location string")
    assert {(r["number"], r["valid"], r["location"]) for r in answer.verify_citations(a, p).collect()} == {(1, True, "a.md, p. 1"), (2, True, "b.md"), (0, False, None), (9, False, None)}
    q = spark.createDataFrame([(1, "why?"), (2, "what?")], "query_id int, text string")
    held = spark.createDataFrame([(1, 2, "b", "Second."), (1, 1, "a", "First text.")], "query_id int, rank int, location string, text string")
    asked = answer.prompts(q, held)
    assert asked.filter("query_id = 1").first()["prompt"] == "[1] (a)\nFirst text.\n\n[2] (b)\nSecond.\n\nQuestion: why?"
    got = {r["query_id"]: (r["text"], r["refused"]) for r in answer.answers(asked, answer.first_sentence).collect()}
    assert got == {1: ("First text. [1]", False), 2: (answer.NO_CONTEXT_ANSWER, True)}
    t = spark.createDataFrame([(1, i, r, x) for i, (r, x) in enumerate([("system", "s"), *[(r, f"{r}{n}" + "y" * 500) for n in range(5) for r in ("user", "assistant")]])], "conv_id int, turn int, role string, text string")
    h = answer.history_window(t)
    assert [(r["position"], r["question"][:5], len(r["answer"])) for r in h.orderBy("position").collect()] == [(1, "user2", 400), (2, "user3", 400), (3, "user4", 400)]
    assert answer.history_window(t, exchanges=0).count() == 0
    c = answer.condense_prompt(h, spark.createDataFrame([(1, "and then?")], "conv_id int, question string")).first()["prompt"]
    assert c.endswith("Last question: and then?") and c.count("Question: ") == 3
    got = spark.createDataFrame([("q", " new \nrest"), ("q", "  "), ("q", None)], "q string, r string").select(answer.condensed(F.col("q"), F.col("r"))).collect()
    assert [r[0] for r in got] == ["new", "q", "q"]


def test_holders_are_those_that_contain(spark):
    rng = random.Random(4)
    texts = [(i, " ".join(rng.choice(["ab", "b", "cab", "abc", "ca"]) for _ in range(rng.randint(0, 30)))) for i in range(80)]
    asked = [(n, t[rng.randint(0, len(t) // 2) : len(t) // 2 + rng.randint(1, 40)].strip()) for n, (_, t) in enumerate(texts[:60])] + [(90, ""), (91, "b"), (92, "zz zz zz zz")]
    got = holders(spark.createDataFrame(texts, "doc_id long, _t string"), spark.createDataFrame(asked, "query_id long, _q string"), 63).collect()
    assert sorted(map(tuple, got)) == sorted((n, i) for n, q in asked for i, t in texts if q in t)


def test_counted_postings_agree_with_separate_readings(spark):
    texts = spark.createDataFrame([(1, "a1 b2 b2"), (2, "cc"), (3, ""), (4, None), (5, "b2"), (5, "b2")], "id long, text string")
    asked = spark.createDataFrame([(1, "b2 a1"), (2, "zz"), (3, ""), (4, None)], "query_id long, text string")
    made, want = retrieval.counted(asked, texts), retrieval.corpus_stats(texts).first()
    rows = lambda t: sorted(map(tuple, t.select("id", "term", "tf", "len").collect()))
    apart = retrieval.postings(texts.filter("id <> 5"), only=retrieval.query_terms(asked).select("term").distinct())
    assert [r for r in rows(made.postings()) if r[0] != 5] == rows(apart) and (made.n, made.avg_len) == tuple(want)
    plain = retrieval.bm25(asked, texts.filter("id <> 5"), 9, post=retrieval.postings(texts.filter("id <> 5")))
    assert sorted(map(tuple, retrieval.bm25(asked, texts.filter("id <> 5"), 9).collect())) == sorted(map(tuple, plain.collect()))
    assert retrieval.bm25(asked.filter("query_id > 2"), texts, 9).collect() == []


def test_queries_in_blocks_find_the_same(spark, monkeypatch):
    rng = random.Random(3)
    vectors = [(i, [rng.random() for _ in range(3)]) for i in range(60)]
    v = spark.createDataFrame(vectors, "id long, embedding array<double>")
    q = v.select(F.col("id").alias("query_id"), F.col("embedding").alias("q")).filter("id % 5 = 0")
    whole = sorted(map(tuple, retrieval.nearest(q, v, 4).collect()))
    monkeypatch.setattr(retrieval, "VECTOR_QUERIES", 3)
    assert sorted(map(tuple, retrieval.nearest(q, v, 4).collect())) == whole


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_are_counted_where_texts_are_read(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "TERMS", 4)
    texts = [(1, "a1 b2 b2"), (2, "cc x é ÉÉ ee"), (3, ""), (4, None), (5, "b2 b2 cc"), (5, "b2 cc dd"), (5, "b2"), (None, "cc"), (None, "cc"), (6, "dd"), (7, "aa " * 9 + "bb")]
    df = spark.createDataFrame(texts, "id long, text string").repartition(2)
    found = df.select("id", F.size(retrieval.terms(F.col("text"))).alias("len"), F.explode(retrieval.terms(F.col("text"))).alias("term"))
    want = found.groupBy("id", "len", "term").agg(F.count("*").alias("tf"))
    rows = lambda t: sorted(map(repr, t.select("id", "len", "term", "tf").collect()))
    assert rows(postings(df)) == rows(want) and dict(postings(df).dtypes) == dict(want.dtypes)
    apart = df.filter("id in (1, 2, 3, 4, 6, 7)").coalesce(1)
    assert rows(postings(apart)) == rows(want.filter("id in (1, 2, 3, 4, 6, 7)"))
    assert "Aggregate" not in planned(postings(apart))
    assert postings(df.limit(0)).collect() == []


def most_at_once(spark):
    """The most of 3000 rows of 4000 characters that a Python worker is handed at once."""
    size = F.pandas_udf(lambda n, t: n * 0 + len(t), "long")
    return spark.range(3000).coalesce(1).select(size("id", F.repeat(F.lit("x"), 4000)).alias("n")).agg(F.max("n")).first()[0]


@pytest.mark.parametrize("operator", [lambda q, c, v: retrieval.counted(q, c), lambda q, c, v: bm25(q, c, 3), lambda q, c, v: nearest(v.select(F.col("id").alias("query_id"), F.col("embedding").alias("q")), v, 3), lambda q, c, v: search(q.limit(0), c, "dense", vectors=v, embed=hashed(1)), lambda q, c, v: search(q, c, "sparse")])
def test_workers_are_handed_bytes_not_rows(spark, chunks, asked, operator):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    assert most_at_once(spark) == 3000
    operator(asked, chunks, spark.createDataFrame([("c1", [1.0])], "id string, embedding array<float>"))
    assert most_at_once(spark) < 1200


def test_weights_need_no_row_a_term_before_they_leave(spark):
    from quern.plans.queries import QUERIES

    made = planned(QUERIES["bm25_weights"](spark, "/root/testdata/sf0.001"))
    assert "Generate" not in made and "HashAggregate(keys=[doc_id" not in made
