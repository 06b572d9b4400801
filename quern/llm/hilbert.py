"""Sharding along a Hilbert curve, in DataFrame functions only.

Each dimension is cut into 2**bits cells at its own quantiles, the cells of a row are one point, and rows
are ordered by the point's index on the curve. Runs of the order are the shards: near rows in every
dimension share a shard, so the minima and maxima of a file prune on any of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stage import Stage, ordered, parts

BITS = 5


def _gray_inverse(g: int) -> int:
    w = 0
    while g:
        w ^= g
        g >>= 1
    return w


def _entry(w: int) -> int:
    e = 0 if w == 0 else 2 * ((w - 1) // 2)
    return e ^ (e >> 1)


def _direction(w: int, n: int) -> int:
    ones = lambda x: ((x + 1) & ~x).bit_length() - 1  # trailing ones
    return 0 if w == 0 else (ones(w - 1) if w % 2 == 0 else ones(w)) % n


def hilbert_index(cells: list[Column], bits: int) -> Column:
    """The position of a point of `bits`-bit cells on the curve (Hamilton's form of the walk).

    The walk is a fold over bit levels. Its state is the entry corner and the axis of the current cube;
    the two corner tables have 2**dimensions entries and come from the Gray code.
    """
    n = len(cells)
    mask = (1 << n) - 1
    table = lambda f: F.array(*[F.lit(f(w)) for w in range(1 << n)])
    # step: what each rank w adds to the state, before rotation
    inverse, entry, axis = table(_gray_inverse), table(_entry), table(lambda w: _direction(w, n))

    def rotate_left(x: Column, by: Column) -> Column:
        power = F.element_at(F.array(*[F.lit(1 << i) for i in range(n + 1)]), (by % n + 1).cast("int"))
        wide = x * power
        return wide.bitwiseAND(F.lit(mask)).bitwiseOR((wide / F.lit(1 << n)).cast("int")).cast("int")

    corner = lambda level: sum(
        (((cell / F.element_at(F.array(*[F.lit(1 << b) for b in range(bits)]), level + 1)).cast("int") % 2) * F.lit(1 << i) for i, cell in enumerate(cells)),
        F.lit(0),
    ).cast("int")

    def step(state: Column, level: Column) -> Column:
        e, d = state["e"], state["d"]
        local = rotate_left(corner(level).bitwiseXOR(e), n - (d + 1) % n)
        w = F.element_at(inverse, local + 1)
        return F.struct(
            (state["h"] * F.lit(1 << n) + w).cast("long").alias("h"),
            e.bitwiseXOR(rotate_left(F.element_at(entry, w + 1), d + 1)).cast("int").alias("e"),
            ((d + F.element_at(axis, w + 1) + 1) % n).cast("int").alias("d"),
        )

    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("e"), F.lit(0).alias("d"))
    return F.aggregate(F.array(*[F.lit(b) for b in reversed(range(bits))]), start, step, lambda s: s["h"])


def _number(df: DataFrame, name: str) -> Column:
    """A double in the order of a column of numbers, dates or times."""
    kind = df.schema[name].dataType
    return (df[name].cast("timestamp") if isinstance(kind, T.DateType) else df[name]).cast("double")


def _is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.StringType, T.BinaryType))


def _text_bounds(df: DataFrame, name: str, cells: int, stage: Stage, table: str) -> list[bytes]:
    """Whole strings that cut a column into cells of about equal counts, from the counts of all its strings.

    In order of the strings, one is a bound where more shares of the rows are full than there are bounds so far. So of the
    strings at which the same number is full, only the first `cells` can be, and no others come to the driver.
    """
    values = df.select(df[name].cast("binary").alias("v")).filter("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    values = ordered(values, stage, table, "v")
    sums = values.groupBy("pid").agg(F.sum("n").alias("n"), F.count("*").alias("k"))
    sums = sums.selectExpr("pid", "sum(n) over (order by pid) - n as n0", "sum(k) over (order by pid) - k as k0", "sum(n) over () as nt", "sum(k) over () as kt")
    values = values.join(F.broadcast(sums), "pid")  # a row for each partition of the order
    values = values.withColumn("run", F.expr("n0 + sum(n) over (partition by pid order by at rows unbounded preceding)"))
    values = values.selectExpr("v", "kt", "k0 + at as k", f"run * {cells} div nt as full").filter("k < kt - 1")
    first = values.withColumn("_r", F.expr("row_number() over (partition by full order by k)")).filter(f"_r <= {cells}")
    bounds = []
    for r in sorted(first.collect(), key=lambda r: r["k"]):
        if r["kt"] <= cells or r["full"] > len(bounds):
            bounds.append(bytes(r["v"]))
    stage.drop(table)
    return bounds


def hilbert_shards(df: DataFrame, dims: list[str], shards: int = 8, size: str | None = None, law: str = "rows", bits: int = BITS, tie: list[str] | None = None) -> DataFrame:
    """`df` with `curve` (long), `shard` (int, from 0) and `slot` (long, gapless from 0 in each shard).

    Law `rows` cuts runs whose row counts are at most one apart; law `bytes` cuts where the running sum of
    `size` passes a multiple of its share, so that a run is off by less than one row at either end.
    Dimensions may be numbers, dates, times or strings, which are compared whole; nulls and NaN go to the first cell. `tie` orders
    rows with an equal index. Repeated rows are places of their own. An empty table gives an empty table.
    Names of columns here: `curve`, `shard` and `slot` replace columns so named.
    """
    if law not in ("rows", "bytes") or (law == "bytes" and not size):
        raise ValueError("law is rows, or bytes with the name of a size column")
    if not dims or bits * len(dims) > 62:
        raise ValueError("at least one dimension, and 62 bits in all")
    stage = Stage(df.sparkSession, "hilbert")
    cells = 1 << bits
    number = {d: _number(df, d) for d in dims if not _is_text(df, d)}
    number = {d: F.when(F.isnan(x), None).otherwise(x) for d, x in number.items()}
    cut = [i / cells for i in range(1, cells)]
    # one row of dims x (cells - 1) numbers, whatever the input
    bounds = df.agg(*[F.percentile_approx(x, cut, 10_000).alias(f"q{i}") for i, x in enumerate(number.values())]).first() if number else []
    steps = {d: (x, sorted(set(bounds[i] or []))) for i, (d, x) in enumerate(number.items())}
    steps |= {d: (df[d].cast("binary"), [bytearray(b) for b in _text_bounds(df, d, cells, stage, f"strings{i}")]) for i, d in enumerate(dims) if d not in number}
    cell = []
    for d in dims:
        x, own = steps[d]
        cell.append(F.coalesce(sum((F.when(x > F.lit(b), 1).otherwise(0) for b in own), F.lit(0)), F.lit(0)).cast("int"))
    pid, at, weight = "pid", "at", "_w"
    keep = [c for c in df.columns if c not in ("curve", "shard", "slot", pid, at, weight)]
    flat = df.select(*[df[c] for c in keep], *[c.alias(f"_c{i}") for i, c in enumerate(cell)], (df[size].cast("long") if law == "bytes" else F.lit(1).cast("long")).alias(weight))
    flat = flat.withColumn("curve", hilbert_index([F.col(f"_c{i}") for i in range(len(dims))], bits)).drop(*[f"_c{i}" for i in range(len(dims))])
    rows = ordered(flat, stage, "order", "curve", *(tie or dims))

    # Running sums in two levels: one row a partition, then rows within their partition.
    sums = rows.groupBy(pid).agg(F.sum(weight).alias("w"), F.count("*").alias("n"))
    sums = sums.selectExpr(
        pid, "sum(w) over (order by pid) - w as w0", "sum(n) over (order by pid) - n as n0", "sum(w) over () as wt", "sum(n) over () as nt"
    )
    rows = rows.join(F.broadcast(sums), pid)  # a row for each partition of the order
    if law == "rows":
        rows = rows.withColumn("rank", F.col("n0") + F.col(at))
        rows = rows.withColumn("shard", F.floor(F.col("rank") * shards / F.col("nt")).cast("int"))
        # the first rank whose shard is s is ceil(s * nt / shards)
        first = F.ceil(F.col("shard") * F.col("nt") / F.lit(shards)).cast("long")
        rows = rows.withColumn("slot", (F.col("rank") - first).cast("long"))
    else:
        within = "sum(_w) over (partition by pid order by at rows unbounded preceding)"
        rows = rows.withColumn("mid", F.col("w0") + F.expr(within) - F.col(weight) / 2)
        rows = rows.withColumn("shard", F.least(F.floor(F.col("mid") * shards / F.col("wt")), F.lit(shards - 1)).cast("int"))
        rows = rows.withColumn("rank", F.col("n0") + F.col(at))
        starts = rows.groupBy("shard").agg(F.min("rank").alias("first"))
        rows = rows.join(F.broadcast(starts), "shard").withColumn("slot", (F.col("rank") - F.col("first")).cast("long"))
    return rows.select(*keep, "curve", "shard", "slot")


def write_shards(sharded: DataFrame, path: str) -> None:
    """Writes one folder a shard, rows in slot order in each file.

    `sharded` comes from a table in the order of the curve, so each task has few shards and nothing is shuffled.
    """
    sharded.sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
