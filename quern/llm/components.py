"""Connected components by alternating large and small stars, on written tables of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import Stage


def _toward(edges: DataFrame, keep: str) -> DataFrame:
    """Each edge (u, v) that meets `keep` as (v, m), m being the least of u and its neighbours in `edges`."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return edges.filter(keep).join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def components(edges: DataFrame, stage: Stage, name: str) -> DataFrame:
    """(node, root) of every node in `edges` (u, v); root is the least node that it reaches.

    Each round is two joins on a least neighbour, so a node with very many links is a skewed join that
    Spark can split, never a gathered list. Ends when a round changes nothing, after about the square of
    the logarithm of the longest path. Nulls and loops are left out.
    """
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()
    mark = lambda t: tuple(t.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
    before, i = mark(now), 0
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _toward(both, "v > u").distinct()
        small = _toward(large, "true").filter("u > v")
        roots = large.groupBy("u").agg(F.min("v").alias("v"))
        i += 1
        now = stage.write(small.unionByName(roots).distinct(), f"{name}-{i}", rows=2 * before[0])
        after = mark(now)
        if after == before:
            break
        before = after
        if i > 1:
            stage.drop(f"{name}-{i - 1}")
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
