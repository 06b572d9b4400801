"""Mixing sources to target weights by temperature.

The token shares of the sources are raised to an exponent and normalised. The exponent is the one nearest to
1, found by bisection, at which the weights reach a target entropy, but no source is repeated more often
than a limit allows. Each source then gets a budget of tokens, and its documents go out in passes: whole
passes over all blocks, and a last one over permuted blocks until the budget is met.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stage import Stage, small, text_of

#: Blocks of a source, documents by hash of their id: at least BLOCKS, and so many that one has some BLOCK_ROWS rows. The boundary block of a pass is ordered row by row.
BLOCKS, BLOCK_ROWS = 1024, 65_536
#: A mix is over sources: more than SOURCES of them, whose shares are planned on the driver, are refused; up to BROADCAST_SOURCES, at some 60 bytes each, go to every task.
SOURCES, BROADCAST_SOURCES = 1_000_000, 200_000


def weights(tokens: dict[str, int], exponent: float) -> dict[str, float]:
    """The share of each source, to the exponent, normalised; of a source without tokens 0."""
    total = sum(tokens.values())
    raised = {s: (n / total) ** exponent if n else 0.0 for s, n in tokens.items()}
    whole = sum(raised.values())
    return {s: r / whole for s, r in raised.items()}


def entropy(shares: dict[str, float]) -> float:
    """As a part of the entropy of equal shares; 1 for one source."""
    held = [w for w in shares.values() if w > 0]
    return -sum(w * math.log(w) for w in held) / math.log(len(held)) if len(held) > 1 else 1.0


def epochs(tokens: dict[str, int], exponent: float, budget: int | None) -> dict[str, float]:
    """Passes over each source. Without a budget the least is 1: the mix drops no document."""
    shares = weights(tokens, exponent)
    passes = {s: shares[s] / n for s, n in tokens.items() if n}
    scale = budget if budget is not None else 1 / min(passes.values())
    return {s: p * scale for s, p in passes.items()}


def _lower_until(holds, steps: int = 60) -> float:
    """The greatest exponent in 0 to 1 for which `holds`, which is true from 0 to some point."""
    if holds(1.0):
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (middle, high) if holds(middle) else (low, middle)
    return low


@dataclass(frozen=True)
class Plan:
    exponent: float
    weights: dict[str, float]
    epochs: dict[str, float]


def plan(tokens: dict[str, int], target_entropy: float, max_repeats: float, budget: int | None = None) -> Plan:
    """The repetition limit wins over the entropy. Where even the shares as they are break it, they stay."""
    tokens = {s: n for s, n in tokens.items() if n}
    if not tokens:
        return Plan(1.0, {}, {})
    wanted = _lower_until(lambda a: entropy(weights(tokens, a)) >= target_entropy)
    fits = lambda a: max(epochs(tokens, a, budget).values()) <= max_repeats * (1 + 1e-12)
    if not fits(wanted):
        wanted = _raise_until(fits, wanted)
    return Plan(wanted, weights(tokens, wanted), epochs(tokens, wanted, budget))


def _raise_until(fits, low: float, steps: int = 60) -> float:
    """The least exponent in low to 1 that fits; 1 where none does."""
    if not fits(1.0):
        return 1.0
    high = 1.0
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (low, middle) if fits(middle) else (middle, high)
    return high


def words(text: Column) -> Column:
    """The token count that shares and budgets go by."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def mix(
    docs: DataFrame, target_entropy: float = 0.95, max_repeats: float = 1.5, budget: int | None = None, seed: int = 0, text: str = "text", source: str = "source", key: str = "doc_id", carry: bool = True
) -> tuple[DataFrame, Plan]:
    """The mixed rows, and the plan. Rows have `pass` (long, from 0) and `block` (long) besides; all columns of `docs` if `carry`, else key, source and `n_tokens`.

    A document goes out once in each whole pass of its source; in the last, unfinished pass while the
    tokens before it, by permuted block and by hash within one, are under what the budget leaves. So a
    source is off its budget by less than one document. Without `budget` every document goes out at least once.

    Nulls: a null source is a source of its own, a null text has no tokens. Documents without tokens go out
    in whole passes and, as they cost nothing, with their neighbours in the last; a source without any goes
    out once. Repeated rows are documents each; which of them go out once more follows their place in `docs`,
    and the budget counts them one by one. More than SOURCES sources are an error. Columns `pass`, `block` and `n_tokens` of `docs` are
    replaced. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "mixing")
    named = F.coalesce(F.concat(F.lit("="), docs[source].cast("string")), F.lit(""))
    count = words(text_of(docs, text))
    draw = F.xxhash64(docs[key].cast("string"), count, F.lit(seed))
    n_blocks = max(BLOCKS, docs.count() // BLOCK_ROWS)
    # `_tie` orders rows of one draw, which repeat an id
    facts = {"_source": named, "n_tokens": count, "_draw": draw, "block": F.pmod(draw, F.lit(n_blocks)), "_tie": F.monotonically_increasing_id()}
    rows = docs.drop("pass").withColumns(facts)
    slim = stage.write(rows.select("_source", "n_tokens", "_draw", "_tie", "block"), "counts")
    # at most `n_blocks` rows a source, however many documents it has
    blocks = stage.write(slim.groupBy("_source", "block").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")), "blocks")
    sums = blocks.groupBy("_source").agg(F.sum("tokens").alias("tokens")).limit(SOURCES + 1).collect()
    if len(sums) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    tokens = {r["_source"]: r["tokens"] for r in sums}
    made = plan(tokens, target_entropy, max_repeats, budget)
    whole = {s: math.floor(e + 1e-9) for s, e in made.epochs.items()}
    passes = [(s, whole[s], max(0.0, e - whole[s]) * tokens[s]) for s, e in made.epochs.items()]
    passes += [(s, 1, 0.0) for s in tokens if s not in made.epochs]
    budgets = spark.createDataFrame(passes, "_source string, whole long, rest double")
    near = lambda t: F.broadcast(t) if len(passes) <= BROADCAST_SOURCES else t

    # blocks are taken in the order of `turn`, up to the one that meets the budget
    turn = F.struct(F.xxhash64("block", F.lit(seed)), "block")
    running = Window.partitionBy("_source").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    order = blocks.withColumn("turn", turn).join(near(budgets), "_source").withColumn("room", F.col("rest") - F.sum("tokens").over(running) + F.col("tokens"))
    order = order.groupBy("_source").agg(
        F.max("whole").alias("whole"),
        F.max(F.when((F.col("room") > 0) & (F.col("room") >= F.col("tokens")), F.col("turn"))).alias("upto"),
        F.max(F.when((F.col("room") > 0) & (F.col("room") < F.col("tokens")), F.struct("block", "room"))).alias("edge"),
    )
    order = stage.write(order, "order")
    # one boundary block a source: only its rows need their own running sum
    edge = slim.join(near(order.filter("edge is not null").select("_source", F.col("edge.block").alias("block"), "edge.room")), ["_source", "block"])
    inside = F.sum("n_tokens").over(Window.partitionBy("_source", "block").orderBy("_draw", "_tie").rowsBetween(Window.unboundedPreceding, 0))
    edge = edge.withColumn("upto", inside - F.col("n_tokens")).filter("upto < room").groupBy("_source").agg(F.max(F.struct("_draw", "_tie")).alias("last"))
    fate = stage.write(order.join(near(edge), "_source", "left").select("_source", "whole", "upto", F.col("edge.block").alias("edge"), "last"), "fate")

    rows = rows.join(small(fate, BROADCAST_SOURCES), "_source")
    last = (turn <= F.col("upto")) | ((F.col("block") == F.col("edge")) & (F.struct("_draw", "_tie") <= F.col("last")))
    times = F.col("whole") + F.when(last, 1).otherwise(0)
    rows = rows.withColumn("_times", times).filter("_times > 0")
    rows = rows.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_times") - 1)))
    if carry:
        return rows.select(*[c for c in docs.columns if c not in ("pass", "block", "n_tokens")], "n_tokens", "pass", "block"), made
    return rows.select(key, source, "n_tokens", "pass", "block"), made
