import hashlib
import random
import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from quern.functions import text as X
from quern.functions.vectors import hashed
from quern.operators import views
from quern.operators.chunk import NAMESPACE, SECTION, ChunkConfig, Section, by_words, chunk_document, chunk_sections, estimate, merged, pack_prose, packed
from quern.operators.index import IndexTable, diff, summary
from quern.sources.corpus import load

words = lambda t: len(t.split())
SMALL = ChunkConfig(target=20, max=30, min=5, overlap=0.2)


def chunks(*sections, title="", config=SMALL):
    return list(chunk_document("s", "0" * 64, title, list(sections), words, config))


@given(st.lists(st.integers(1, 25), max_size=40), st.integers(0, 9))
@settings(deadline=None, max_examples=200)
def test_packs_hold_every_unit_in_order(sizes, overlap):
    parts = [f"u{i}" for i in range(len(sizes))]
    got = list(packed(parts, sizes, 25, overlap))
    fresh, last = [], -1
    for p in got:
        ids = [int(u[1:]) for u in p]
        assert ids == list(range(ids[0], ids[-1] + 1)) and sum(sizes[i] for i in ids) <= 25
        assert sum(sizes[i] for i in ids if i <= last) <= overlap
        fresh += [i for i in ids if i > last]
        last = ids[-1]
    assert fresh == list(range(len(sizes)))


def test_no_chunk_is_over_the_limit_and_heads_repeat():
    long = " ".join(f"w{i}" for i in range(200))
    assert all(c["token_count"] <= 30 for c in chunks(Section(long), title="T"))
    table = "\n".join(["| a | b |", "|---|---|", *[f"| {i} | x y z |" for i in range(20)]])
    parts = chunks(Section(table, kind="table"))
    assert len(parts) > 1 and all(c["text"].startswith("| a | b |\n|---|---|\n") for c in parts)
    record = "\n".join(["Id : 7", *[f"field{i} : some value here" for i in range(12)]])
    parts = chunks(Section(record, kind="record"))
    assert len(parts) > 1 and all(c["text"].startswith("Id : 7\n") for c in parts)
    assert list(by_words("a bb ccc", 1, len)) == ["a", "bb", "ccc"]


def test_small_sections_merge_only_under_one_heading():
    a, b, c = Section("one two", ("H",), page_start=1, page_end=1), Section("three four", ("H",), page_start=2, page_end=2), Section("five", ("I",))
    got = list(merged([a, b, c], words, SMALL))
    assert [(s.text, s.page_start, s.page_end) for s in got] == [("one two\n\nthree four", 1, 2), ("five", None, None)]
    assert len(list(merged([Section("a", kind="table"), Section("b")], words, SMALL))) == 2


def test_ids_and_validation():
    got = chunks(Section("hello world", ("H",)), title="T")
    assert got[0]["id"] == str(uuid.uuid5(NAMESPACE, "0" * 64 + ":0")) and got[0]["text"] == "T › H\n\nhello world"
    for bad in (dict(overlap=0.5), dict(target=800)):
        with pytest.raises(ValueError):
            ChunkConfig(**bad)
    for bad in (dict(page_start=1), dict(page_start=3, page_end=2), dict(page_start=0, page_end=1)):
        with pytest.raises(ValueError):
            Section("x", **bad)


def test_fold_in_the_jvm_equals_the_plain_packing(spark):
    rng = random.Random(1)
    rows = [(i, ["x" * rng.choice([1, 30, 200, 800, 1500]) for _ in range(rng.randint(0, 25))]) for i in range(60)]
    got = spark.createDataFrame(rows, "i int, parts array<string>").select("i", pack_prose(F.col("parts"), 400, 60).alias("p")).collect()
    for r in got:
        parts = dict(rows)[r["i"]]
        assert [list(p) for p in r["p"]] == list(packed(parts, [estimate(u) for u in parts], 400, 60))


def test_text_functions(spark):
    one = lambda e, **v: spark.range(1).select(*[F.lit(x).alias(k) for k, x in v.items()]).select(e).first()[0]
    t = F.col("t")
    assert one(X.normalize_spaces(t), t="\xa0a­ b \t\xa0c\nd ") == "a b c\nd"
    assert one(X.terms(t), t="Réf MW-104, v4.2.1: straße x ÉTÉ") == ["ref", "mw-104", "v4.2.1", "stra", "ete"]
    assert one(X.terms(t, exact=True), t="ﬁne ｗide") == ["fine", "wide"]
    assert one(X.estimate_tokens(t), t="") == 0 and one(X.estimate_tokens(t), t="a") == 1 and one(X.estimate_tokens(t), t="a" * 100) == 33
    assert one(X.chunk_id(t, F.lit(3)), t="ab" * 32) == str(uuid.uuid5(NAMESPACE, "ab" * 32 + ":3"))
    assert one(X.location(t, F.lit(2), F.lit(3), F.array(F.lit("A"), F.lit("B"))), t="d.pdf") == "d.pdf, p. 2-3 — A › B"
    assert one(X.term_id(t), t="pump") == int.from_bytes(hashlib.blake2b(b"pump", digest_size=4).digest(), "big")
    assert one(X.sse_delta(t), t='data: {"choices":[{"delta":{"content":"hi"}}]}') == "hi" and one(X.sse_delta(t), t="data: [DONE]") == ""
    assert one(X.excerpt(t, 10), t="crumb\n\nlong   text that\ngoes on") == "long text…"
    assert one(X.join_wrapped_lines(F.split(t, "\n")), t="A long wo-\nrd and\nmore\n- item\nkeeps -\non") == "A long word and more\n- item keeps - on"
    assert one(X.is_all_caps(t), t="ABC 1") and not one(X.is_all_caps(t), t="123")
    urls = {"http://10.0.0.1/x": True, "http://8.8.8.8": False, "http://localhost:1": True, "http://embed:80": True, "https://api.example.com": False, "http://a.lan": True, "http://172.16.0.1": True, "http://172.32.0.1": False, "http://[::1]:8": True, "http://169.254.1.1": True, "": False}
    got = spark.createDataFrame(list(urls.items()), "u string, want boolean").select("u", X.is_private_endpoint(F.col("u")).alias("p"), "want").collect()
    assert [r["u"] for r in got if r["p"] != r["want"]] == []


def content(spark, files):
    return spark.createDataFrame([(s, hashlib.sha256(t.encode()).hexdigest(), bytearray(t.encode())) for s, t in files.items()], "source string, sha256 string, content binary")


def test_index_cycle(spark, tmp_path):
    table, embed = IndexTable(spark, f"file://{tmp_path}/index"), hashed(4)
    assert not table.exists() and table.count() == 0
    table.create(4)
    table.create(4)
    with pytest.raises(ValueError):
        table.create(8)
    actions = lambda files, **k: {r["source"]: (r["action"], r["stale"]) for r in table.sync(content(spark, files), embed, load, **k).collect()}
    files = {"a.md": "# A\n\nfirst text", "b.md": "# B\n\nsecond text"}
    assert actions(files) == {"a.md": ("added", False), "b.md": ("added", False)}
    version = table.info()["version"]
    assert actions(files) == {"a.md": ("unchanged", False), "b.md": ("unchanged", False)} and table.info()["version"] == version
    files["a.md"] = "# A\n\nchanged text"
    assert actions(files)["a.md"] == ("updated", False)
    assert sorted(r["text"] for r in table.chunks.collect()) == ["A › A\n\nchanged text", "B › B\n\nsecond text"] and table.postings.count() and table.dense.count() == 2
    assert actions(files, force=True) == {"a.md": ("unchanged", False), "b.md": ("unchanged", False)} and table.info()["version"] != version
    assert actions({"a.md": "", "c.xlsx": "no zip"}) == {"a.md": ("failed", True), "b.md": ("removed", False), "c.xlsx": ("failed", False)}
    assert [r["source"] for r in table.chunks.collect()] == ["a.md"]
    table.snapshot(f"file://{tmp_path}/copy")
    table.delete_source("a.md")
    assert table.count() == 0 and IndexTable(spark, f"file://{tmp_path}/copy").count() == 1
    with pytest.raises(Exception):
        table.upsert(table.chunks, spark.createDataFrame([("x", [1.0])], "id string, embedding array<float>"))
    table.drop()
    assert not table.exists()


def test_diff_and_views(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "source string, sha256 string")
    old = spark.createDataFrame([("b", "2"), ("c", "0"), ("d", "4")], "source string, sha256 string")
    assert {r["source"]: r["action"] for r in diff(now, old).collect()} == {"a": "added", "b": "unchanged", "c": "updated", "d": "removed"}
    assert {r["action"]: r["sources"] for r in summary(diff(now, old)).collect()} == {"added": 1, "unchanged": 1, "updated": 1, "removed": 1}
    docs = spark.createDataFrame([("a.md", "0" * 64, "T", [("word " * 50, ["H"], "prose", None, None, None, None, None), ("Id : 1", [], "record", 1, 1, 2, "S", "1")])], "source string, sha256 string, title string, sections array<struct<text:string,heading_path:array<string>,kind:string,page_start:int,page_end:int,row:int,sheet:string,rec_id:string>>")
    made = chunk_sections(docs)
    assert [(r["kind"], r["row"], r["page_start"]) for r in made.orderBy("index").collect()] == [("prose", None, None), ("record", 2, 1)]
    got = views.inspect(made).first()
    assert (got["documents"], got["chunks"], got["prose"], got["record"]) == (1, 2, 1, 1)
    assert [tuple(r) for r in views.sources(made).collect()] == [("a.md", 2)] and views.sources_total(made).count() == 2
    assert views.passage_view(made.withColumn("score", F.lit(0.123456))).filter("location = 'a.md, p. 1 — '").count() == 0
    assert views.health(spark.createDataFrame([("x", True), ("y", False)], "service string, reachable boolean")).first()["status"] == "degraded"
    reqs = spark.createDataFrame([("q", 3, [], "dense"), ("", 3, [], None), ("q", 21, [], None), ("q", None, None, "odd")], "query string, top_k int, history array<string>, mode string")
    assert views.valid_requests(reqs).count() == 1


def test_prose_chunks_cut_sentences_over_the_limit(spark):
    """Against plain greedy packing: a text that fits is whole, else paragraphs, sentences and runs of words, none over the limits."""
    from quern.operators.chunk import prose_chunks

    long_sentence = " ".join(f"word{i}" for i in range(2000))
    fits = "First sentence here. " * 90  # over the target, under the maximum
    paragraphs = "\n\n".join(f"Paragraph {i} {'text ' * 60}end. Another one." for i in range(12))
    texts = {1: long_sentence, 2: fits, 3: f"Short one. {long_sentence}. Last one.", 4: paragraphs, 5: "x" * 3000, 6: "", 7: " \n", 8: None, 9: "Small."}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {}
    for r in prose_chunks(docs).orderBy("doc_id", "index").collect():
        assert r["token_count"] == max(1, round(len(r["text"]) / 3.0))
        got.setdefault(r["doc_id"], []).append(r["text"])
    assert set(got) == {1, 2, 3, 4, 5, 9}
    assert got[2] == [fits] and got[9] == ["Small."] and got[5] == ["x" * 3000]
    size = lambda s: max(1, round(len(s) / 3.0))
    run, want = [], []
    for word in long_sentence.split():
        if run and size(" ".join([*run, word])) > 400:
            want.append(" ".join(run))
            run = []
        run.append(word)
    assert got[1] == [*want, " ".join(run)]
    assert all(size(c) <= 700 for i in (1, 2, 3, 4) for c in got[i])
    assert [w for c in got[3] for w in c.split()] == texts[3].split()
    kept = [p for c in got[4] for p in c.split("\n\n")]
    assert set(kept) == set(paragraphs.split("\n\n"))


@pytest.mark.parametrize("operator", [lambda files: load(files), lambda files: chunk_sections(files.selectExpr("source", "'' sha256", "'' title", f"cast(array() as array<{SECTION}>) sections"))])
def test_workers_are_handed_bytes_of_files(spark, operator):
    size = F.pandas_udf(lambda n, t: n * 0 + len(t), "long")
    most = lambda: spark.range(3000).coalesce(1).select(size("id", F.repeat(F.lit("x"), 4000)).alias("n")).agg(F.max("n")).first()[0]
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    assert most() == 3000
    operator(spark.createDataFrame([("a.md", bytearray(b"# A"))], "source string, content binary"))
    assert most() < 1200
