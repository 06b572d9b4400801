from pyspark.sql import functions as F
from quern.functions.vectors import hashed
from quern.operators import layout
from quern.operators.index import IndexTable
from quern.streaming.ingest import event_windows, ingest_stream

ITEMS = "doc_key string, page int, y double, x double, x_end double, text string, kind string, size double, bold boolean"


def item(page, y, text, size=10.0, bold=False, kind="prose", x=60.0, x_end=300.0):
    return ("d", page, float(y), float(x), float(x_end), text, kind, size, bold)


def texts(df, *order):
    return [r["text"] for r in df.orderBy(*order).collect()]


def test_two_columns_in_reading_order(spark):
    words = [("d", 1, x + 30.0 * k, x + 30.0 * k + 26, 100.0 + 20 * n, 110.0 + 20 * n) for n in range(3) for x in (60.0, 320.0) for k in range(6)]
    lines = layout.word_lines(spark.createDataFrame(words, "doc_key string, page int, x double, x_end double, top double, bottom double"))
    g = layout.gutters(lines, spark.createDataFrame([("d", 1, 595.0)], "doc_key string, page int, width double"))
    r = g.first()
    assert 230 < r["left"] < r["right"] < 325
    rows = [item(1, 50, "Wide", x=60, x_end=500), *[item(1, 100 + 20 * n, f"{c}{n}", x=x, x_end=x + 176) for n in range(3) for c, x in (("L", 60.0), ("R", 320.0))]]
    got = layout.reading_order(spark.createDataFrame(rows, ITEMS), g)
    assert texts(got, "pos") == ["Wide", "L0", "L1", "L2", "R0", "R1", "R2"]
    assert layout.gutters(lines.filter(F.col("line") < 55), spark.createDataFrame([("d", 1, 595.0)], "doc_key string, page int, width double")).count() == 0


def test_contents_cover_heads_and_title(spark):
    toc = [item(1, 100 + n, f"Part {n} ........ {n}") for n in range(3)] + [item(2, 100, "Kept")]
    assert texts(layout.drop_contents_pages(spark.createDataFrame(toc, ITEMS)), "page") == ["Kept"]
    cover = [item(1, 100, "A Very Large Title", 30.0), item(1, 200, "Short one", 20.0), item(2, 100, "body " * 300)]
    df = spark.createDataFrame(cover, ITEMS)
    assert {r["page"] for r in layout.drop_cover(df).collect()} == {2}
    assert layout.body_sizes(df).first()["body"] == 10.0
    meta = spark.createDataFrame([("d", " ", "the_file-name"), ("e", "Given", "x"), ("f", None, "the_file-name")], "doc_key string, title string, stem string")
    assert {r["doc_key"]: r["title"] for r in layout.titles(df, meta).collect()} == {"d": "A Very Large Title", "e": "Given", "f": "the file name"}
    pages = spark.createDataFrame([("d", n, 800.0, 4) for n in range(1, 5)], "doc_key string, page int, height double, pages int")
    heads = [item(n, 20, f"Footer {n}") for n in range(1, 5)] + [item(1, 780, "Once")] + [item(n, 400, "Body 1") for n in range(1, 5)]
    assert sorted(texts(layout.drop_running_heads(spark.createDataFrame(heads, ITEMS), pages), "page")) == ["Body 1"] * 4 + ["Once"]


def test_sections_across_pages(spark):
    rows = [(1, "Big", 20.0, False, "prose"), (1, "Title", 20.0, False, "prose"), (1, "Text one.", 10.0, False, "prose"), (2, "- item", 10.0, False, "prose"), (2, "| a |", 10.0, False, "table"), (2, "Sub", 14.0, False, "prose"), (2, "More text here.", 10.0, False, "prose"), (3, "IV. Numbered", 10.0, True, "prose"), (3, "End of it all.", 10.0, False, "prose")]
    df = spark.createDataFrame([item(p, 100.0 * i, t, s, b, k) for i, (p, t, s, b, k) in enumerate(rows)], ITEMS)
    got = layout.build_sections(layout.mark_headings(df).withColumn("pos", F.col("y")))
    assert [(r["text"], r["heading_path"], r["kind"], r["page_start"], r["page_end"]) for r in got.orderBy("pos").collect()] == [
        ("Text one.\n- item", ["Big Title"], "prose", 1, 2), ("| a |", ["Big Title"], "table", 2, 2), ("More text here.", ["Big Title", "Sub"], "prose", 2, 2), ("End of it all.", ["Big Title", "Sub", "IV. Numbered"], "prose", 3, 3)
    ]
    heads = spark.createDataFrame([([(1, "A"), (3, "B"), (3, "C"), (2, "D")],)], "h array<struct<level:int,title:string>>")
    assert heads.select(layout.path_fold(F.col("h"))).first()[0] == ["A", "D"]


def test_blocks_outside_tables(spark):
    spans = [("d", 1, 0, 0, 10.0, 50.0, 10.0, 20.0, "Wrap-", 10.0, False), ("d", 1, 0, 1, 10.0, 50.0, 20.0, 30.0, "ped line", 10.04, True), ("d", 1, 1, 0, 100.0, 150.0, 100.0, 110.0, "in table", 9.0, False)]
    s = spark.createDataFrame(spans, "doc_key string, page int, block int, line int, x double, x_end double, y double, y_end double, text string, size double, bold boolean")
    t = spark.createDataFrame([("d", 1, 90.0, 200.0, 90.0, 200.0)], "doc_key string, page int, x double, x_end double, y double, y_end double")
    assert [(r["text"], r["size"], r["bold"]) for r in layout.text_blocks(s, t).collect()] == [("Wrapped line", 10.0, False)]


def test_stream_into_the_index(spark, tmp_path):
    index = IndexTable(spark, f"file://{tmp_path}/index")
    index.create(8)
    (tmp_path / "in").mkdir()
    for n, text in enumerate(("# A\n\nfirst", "# B\n\nsecond")):
        (tmp_path / "in" / f"f{n}.md").write_text(text)
        ingest_stream(spark, f"file://{tmp_path}/in", index, hashed(8), f"file://{tmp_path}/check").awaitTermination()
        assert index.count() == n + 1
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:00:00", "b", 3.0)], "t string, event_type string, value double").withColumn("ts", F.to_timestamp("t"))
    assert sorted((r["event_type"], r["n"], r["total"]) for r in event_windows(events).collect()) == [("a", 2, 3.0), ("b", 1, 3.0)]
