"""Exact dedup by progressive refinement, in DataFrame functions only.

Three narrowing passes: texts of equal length; of those, texts with an equal hash of their first
characters; of those, texts with an equal SHA-256. Only rows that the first two passes leave are hashed
whole for grouping. No pass gathers a group: each is a count by key that is combined before the shuffle,
so one text in a third of all rows is one row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stage import Stage, text_of

#: Characters under the prefix hash.
PREFIX = 64
#: Surviving (length, prefix hash) groups up to this many, at 16 bytes each, are broadcast; more are joined by a shuffle.
BROADCAST_GROUPS = 500_000


def normalised(text: Column) -> Column:
    """The text with each run of ASCII white space as one space."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def exact_dedup(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `df`: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after `normalised`. `keep_id` is the smallest key of the group.

    Nulls: a null text is the empty text; a null key never wins over another and is kept only where its
    whole group has none. Repeated rows count as members each; rows that repeat the winning key are all
    kept, as the key is what names a document. Empty texts form a group like any other. Extra columns,
    whatever their names, are not read. An empty table gives an empty table.
    """
    stage = Stage(df.sparkSession, "exact-dedup")
    norm = normalised(text_of(df, text))
    rows = df.select(df[key].alias("k"), norm.alias("t"))
    slim = stage.write(rows.select("k", F.length("t").alias("n"), F.xxhash64(F.substring("t", 1, PREFIX)).alias("p")), "lengths")

    # counted before anything is joined: a length or prefix of a third of all rows is one row here
    counts = stage.write(slim.groupBy("n", "p").agg(F.count("*").alias("c")), "counts")
    lengths = counts.groupBy("n").agg(F.sum("c").alias("c")).filter("c > 1").select("n")
    groups = stage.write(counts.filter("c > 1").join(lengths, "n", "left_semi").select("n", "p"), "groups")

    keyed = rows.withColumns({"n": F.length("t"), "p": F.xxhash64(F.substring("t", 1, PREFIX))})
    if groups.count() <= BROADCAST_GROUPS:
        left = keyed.join(F.broadcast(groups), ["n", "p"], "left_semi")
    else:
        # by key, not by group: texts of a hot group stay spread
        named = slim.join(groups, ["n", "p"], "left_semi").select("k").distinct()
        left = keyed.join(named, keyed["k"].eqNullSafe(named["k"]), "left_semi")
    classes = (
        left.groupBy(F.sha2("t", 256).alias("text_sha256")).agg(F.min("k").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1")
    )
    classes = stage.write(classes, "classes")

    hashed = rows.select("k", F.sha2("t", 256).alias("text_sha256"))
    out = hashed.join(classes, "text_sha256", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("k")).otherwise(F.col("keep_id"))
    return out.select(
        F.col("k").alias("doc_id"),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("k").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )
