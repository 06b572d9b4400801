"""Page layout as operators on tables of items.

`items`: doc_key, page, y, x, x_end, text, kind, size, bold. Every window is within a page or a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import LEADER, NUMBERED, is_bullet

# Fixed values of the heuristics.
GUTTER_FROM, GUTTER_TO, GUTTER_STEPS, GUTTER_COVERED, GUTTER_WIDTH, GUTTER_LINES = 0.25, 0.75, 400, 0.2, 0.03, 2
TOP, BOTTOM, COVER_CHARS = 0.08, 0.88, 600
HEADING_CHARS, BOLD_HEADING_CHARS, TITLE_CHARS = 200, 120, 15


def word_lines(words: DataFrame) -> DataFrame:
    """Words (doc_key, page, x, x_end, top, bottom) as lines: (doc_key, page, line, top, bottom, words)."""
    line = F.round((F.col("top") + F.col("bottom")) / 2 / 2.0).cast("int")
    return words.withColumn("line", line).groupBy("doc_key", "page", "line").agg(
        F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.array_sort(F.collect_list(F.struct("x", "x_end"))).alias("words")
    )


def gutters(lines: DataFrame, widths: DataFrame) -> DataFrame:
    """(doc_key, page, left, right): the widest run of places that few lines cover, between two columns.

    A grid of at most GUTTER_STEPS / 2 places a page meets the page's own lines; nothing meets other pages.
    """
    page = Window.partitionBy("doc_key", "page")
    step = F.greatest(F.col("width") / GUTTER_STEPS, F.lit(0.5))
    grid = widths.withColumn("step", step).select("doc_key", "page", "width", "step", F.explode(F.sequence(F.lit(0), F.floor(F.col("width") * (GUTTER_TO - GUTTER_FROM) / F.col("step")).cast("int"))).alias("i"))
    grid = grid.withColumn("at", F.col("width") * GUTTER_FROM + F.col("i") * F.col("step"))
    on = F.exists("words", lambda w: (w["x"] <= F.col("at")) & (w["x_end"] >= F.col("at")))
    right_of = F.exists("words", lambda w: w["x"] > F.col("at"))
    left_of = F.exists("words", lambda w: w["x_end"] < F.col("at"))
    covered = grid.join(lines, ["doc_key", "page"]).groupBy("doc_key", "page", "width", "step", "i", "at").agg(
        F.count("*").alias("lines"), F.count_if(on).alias("on"), F.count_if(~on & left_of).alias("left_lines"), F.count_if(~on & right_of).alias("right_lines")
    )
    free = covered.filter((F.col("lines") >= 3) & (F.col("on") <= GUTTER_COVERED * F.col("lines")))
    runs = free.withColumn("run", F.col("i") - F.row_number().over(page.orderBy("i"))).groupBy("doc_key", "page", "width", "run").agg(
        F.min("at").alias("left"), F.max("at").alias("right"), F.max("left_lines").alias("left_lines"), F.max("right_lines").alias("right_lines")
    )
    wide = runs.filter((F.col("right") - F.col("left") >= GUTTER_WIDTH * F.col("width")) & (F.col("left_lines") >= GUTTER_LINES) & (F.col("right_lines") >= GUTTER_LINES))
    best = F.struct(F.col("right") - F.col("left"), -F.col("left"))
    return wide.groupBy("doc_key", "page").agg(F.max_by("left", best).alias("left"), F.max_by("right", best).alias("right"))


def text_blocks(spans: DataFrame, tables: DataFrame) -> DataFrame:
    """Spans (doc_key, page, block, line, x, x_end, y, y_end, text, size, bold) as blocks, without those whose centre is in a table's box."""
    lines = spans.groupBy("doc_key", "page", "block", "line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "text"))), lambda s: s["text"]), "").alias("text"),
        F.max("size").alias("size"), F.every("bold").alias("bold"), F.min("x").alias("x"), F.max("x_end").alias("x_end"), F.min("y").alias("y"), F.max("y_end").alias("y_end"),
    )
    from quern.functions.text import join_wrapped_lines

    blocks = lines.groupBy("doc_key", "page", "block").agg(
        join_wrapped_lines(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda s: s["text"])).alias("text"),
        F.round(F.max("size"), 1).alias("size"), F.every("bold").alias("bold"), F.min("x").alias("x"), F.max("x_end").alias("x_end"), F.min("y").alias("y"), F.max("y_end").alias("y_end"),
    )
    b, t = blocks.alias("b"), tables.alias("t")
    middle = lambda lo, hi: (F.col(f"b.{lo}") + F.col(f"b.{hi}")) / 2
    inside = (F.col("b.doc_key") == F.col("t.doc_key")) & (F.col("b.page") == F.col("t.page")) & middle("x", "x_end").between(F.col("t.x"), F.col("t.x_end")) & middle("y", "y_end").between(F.col("t.y"), F.col("t.y_end"))
    return b.join(t, inside, "left_anti")


def reading_order(items: DataFrame, gutter: DataFrame) -> DataFrame:
    """`items` with `pos`: by bands that full-width items close, in a band by column, then y and x."""
    rows = items.join(gutter, ["doc_key", "page"], "left")
    spans = F.coalesce((F.col("x") < F.col("left")) & (F.col("x_end") > F.col("right")), F.col("left").isNull())
    page = Window.partitionBy("doc_key", "page")
    y = F.round("y", 1)
    rows = rows.withColumn("_wide", spans.cast("int")).withColumn("_band", 2 * F.sum("_wide").over(page.orderBy(y, "x").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_wide"))
    column = F.when(F.col("_wide") == 1, 0).when(F.col("x") >= F.col("left"), 1).otherwise(0)
    order = page.orderBy("_band", column, y, "x")
    return rows.withColumn("pos", F.row_number().over(order)).drop("_wide", "_band", "left", "right")


def drop_contents_pages(items: DataFrame) -> DataFrame:
    page = Window.partitionBy("doc_key", "page")
    n, dots = F.count("*").over(page), F.count_if(F.col("text").rlike(LEADER)).over(page)
    return items.withColumn("_toc", (n >= 3) & (dots >= F.greatest(F.lit(3), F.floor(n / 2)))).filter("not _toc").drop("_toc")


def drop_running_heads(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Without margin items whose text, digits aside, stands on many pages. `pages`: doc_key, page, height, pages."""
    rows = items.join(pages.select("doc_key", "page", "height", "pages"), ["doc_key", "page"])
    margin = (F.col("y") <= TOP * F.col("height")) | (F.col("y") >= BOTTOM * F.col("height"))
    rows = rows.withColumn("_key", F.when(margin, F.regexp_replace("text", r"(?U)\d+", "#")))
    n = F.count("_key").over(Window.partitionBy("doc_key", "_key"))
    rows = rows.withColumn("_often", F.col("_key").isNotNull() & (n >= F.greatest(F.lit(3), F.floor(F.col("pages") / 2))))
    return rows.filter("not _often").drop("_key", "_often", "height", "pages")


def body_sizes(items: DataFrame) -> DataFrame:
    """(doc_key, body): the font size with the most characters of prose; of equals the one seen first."""
    sizes = items.filter("kind = 'prose'").groupBy("doc_key", "size").agg(F.sum(F.length("text")).alias("n"), F.min(F.struct("page", "y", "x")).alias("first"))
    order = Window.partitionBy("doc_key").orderBy(F.desc("n"), "first")
    return sizes.withColumn("_r", F.row_number().over(order)).filter("_r = 1").select("doc_key", F.col("size").alias("body"))


def drop_cover(items: DataFrame) -> DataFrame:
    """Without page 1 where it has prose, little of it, and all larger than the body."""
    rows = items.join(body_sizes(items), "doc_key", "left")
    first = rows.filter("page = 1 and kind = 'prose'").groupBy("doc_key").agg(F.sum(F.length("text")).alias("n"), F.every(F.col("size") > F.col("body")).alias("large"))
    cover = first.filter((F.col("n") < COVER_CHARS) & F.col("large")).select("doc_key", F.lit(1).alias("page"))
    return items.join(cover, ["doc_key", "page"], "left_anti")


def mark_headings(items: DataFrame) -> DataFrame:
    """`items` with `level`: of headings their rank among larger sizes; of bold numbered ones of body size the next."""
    rows = items.join(body_sizes(items), "doc_key", "left")
    text = F.col("text")
    short = (F.col("kind") == "prose") & (F.length(text) <= HEADING_CHARS) & ~text.contains("\n") & ~is_bullet(text)
    large = F.col("size") >= F.col("body") + 1
    numbered = F.col("bold") & (F.col("size") >= F.col("body")) & (F.length(text) <= BOLD_HEADING_CHARS) & text.rlike(NUMBERED)
    rows = rows.withColumn("_candidate", F.coalesce(short & (large | numbered), F.lit(False)))
    own = F.when(F.col("_candidate") & (F.col("size") > F.col("body")), F.col("size"))
    sizes = rows.select("doc_key", own.alias("size")).filter("size is not null").distinct()
    rank = sizes.withColumn("_rank", F.row_number().over(Window.partitionBy("doc_key").orderBy(F.desc("size"))))
    count = rank.groupBy("doc_key").agg(F.max("_rank").alias("_sizes"))
    rows = rows.join(rank, ["doc_key", "size"], "left").join(count, "doc_key", "left")
    level = F.when(F.col("_candidate"), F.coalesce("_rank", F.coalesce("_sizes", F.lit(0)) + 1)).cast("int")
    return rows.withColumn("level", level).drop("body", "_candidate", "_rank", "_sizes")


def build_sections(items: DataFrame) -> DataFrame:
    """Items in order (doc_key, pos, level) as sections: doc_key, pos, text, heading_path, kind, page_start, page_end.

    A heading ends a section and sets the path by position: level l keeps the first l - 1 headings.
    Headings of one level in a row are one heading. Tables stand alone. The fold is over one document's items.
    """
    order = Window.partitionBy("doc_key").orderBy("page", "pos")
    rows = items.withColumn("_again", F.coalesce((F.lag("level").over(order) == F.col("level")), F.lit(False)))
    rows = rows.withColumn("_head", F.sum((F.col("level").isNotNull() & ~F.col("_again")).cast("int")).over(order))
    rows = rows.withColumn("_cut", ((F.col("level").isNotNull() & ~F.col("_again")) | (F.col("kind") == "table") | F.coalesce(F.lag("kind").over(order) == "table", F.lit(False))).cast("int"))
    rows = rows.withColumn("_sec", F.sum("_cut").over(order))
    held = lambda *c: F.array_sort(F.collect_list(F.struct("page", "pos", *c)))
    heads = rows.filter("level is not null").groupBy("doc_key", "_head").agg(F.first("level").alias("level"), F.array_join(F.transform(held("text"), lambda h: h["text"]), " ").alias("title"))
    heads = heads.withColumn("_all", held_heads()).withColumn("path", path_fold(F.col("_all"))).select("doc_key", "_head", "path")
    body = rows.filter("level is null").groupBy("doc_key", "_head", "_sec", "kind").agg(held("text").alias("_t"), F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.min(F.struct("page", "pos")).alias("_first"))
    join = F.aggregate(F.transform("_t", lambda t: t["text"]), F.lit(""), lambda s, t: F.when(s == "", t).when(is_bullet(t), F.concat(s, F.lit("\n"), t)).otherwise(F.concat(s, F.lit("\n\n"), t)))
    out = body.join(heads, ["doc_key", "_head"], "left")
    number = F.row_number().over(Window.partitionBy("doc_key").orderBy("_first")) - 1
    return out.select("doc_key", number.alias("pos"), join.alias("text"), F.coalesce("path", F.array().cast("array<string>")).alias("heading_path"), "kind", "page_start", "page_end")


def held_heads() -> Column:
    """The headings of a document up to a row, in order."""
    return F.collect_list(F.struct("level", "title")).over(Window.partitionBy("doc_key").orderBy("_head"))


def path_fold(heads: Column) -> Column:
    """The heading path after headings (level, title): each keeps the first level - 1 of the path before it."""
    return F.aggregate(heads, F.array().cast("array<string>"), lambda path, h: F.concat(F.slice(path, F.lit(1), F.least(F.greatest(h["level"] - 1, F.lit(0)), F.size(path))), F.array(h["title"])))


def titles(items: DataFrame, meta: DataFrame) -> DataFrame:
    """(doc_key, title): of `meta` (doc_key, title, stem) the title; else the longest text of the largest size on page 1; else the stem."""
    page = items.filter("page = 1 and kind = 'prose'")
    top = page.groupBy("doc_key").agg(F.max("size").alias("size"))
    best = page.join(top, ["doc_key", "size"]).filter(F.length("text") >= TITLE_CHARS).groupBy("doc_key").agg(F.max_by("text", F.struct(F.length("text"), -F.col("y"))).alias("_best"))
    return meta.join(best, "doc_key", "left").select("doc_key", F.coalesce(F.nullif(F.trim("title"), F.lit("")), "_best", F.translate("stem", "_-", "  ")).alias("title"))
