import bisect
import itertools
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from quern.llm.hilbert import hilbert_index, hilbert_shards, write_shards
from quern.llm.queries import op9_hilbert_sharding


@pytest.mark.parametrize("n, bits", [(1, 4), (2, 3), (3, 2), (4, 2)])
def test_curve_visits_every_cell_by_neighbours(spark, n, bits):
    cells = list(itertools.product(range(1 << bits), repeat=n))
    df = spark.createDataFrame(cells, ", ".join(f"c{i} int" for i in range(n)))
    got = df.withColumn("h", hilbert_index([F.col(f"c{i}") for i in range(n)], bits)).orderBy("h").collect()
    assert [r["h"] for r in got] == list(range(len(cells)))
    for a, b in itertools.pairwise(got):
        assert sum(abs(x - y) for x, y in zip(a[:-1], b[:-1])) == 1


def rows_of(n):
    rng = random.Random(n)
    rows = [(i, rng.choice(["hot"] * 5 + ["cold", None]), rng.choice(["en", "fr", ""]), rng.choice([1, 10, 1000, None]), float("nan") if i % 9 == 0 else i / 7, "clash", 1) for i in range(n)]
    return rows + rows[:5]


@pytest.mark.parametrize("n", [0, 1, 5, 403])
@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_laws(spark, n, law):
    df = spark.createDataFrame(rows_of(n), "doc_id long, source string, lang string, size long, x double, shard string, pid int").fillna(3, ["size"])
    out = hilbert_shards(df.repartition(3), ["source", "lang", "size", "x"], shards=8, law=law, size="size")
    got = out.collect()
    assert len(got) == len(rows_of(n)) and sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows_of(n))
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    order = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    assert all(a["curve"] <= b["curve"] for a, b in itertools.pairwise(order))
    if law == "rows":
        counts = [len(by.get(s, [])) for s in range(8)]
        assert max(counts) - min(counts) <= 1
    elif n > 300:
        sizes = [sum(r["size"] for r in by.get(s, [])) for s in range(8)]
        assert max(sizes) - min(sizes) <= 2000 and set(by) == set(range(8))


def test_query_and_files(spark, tmp_path):
    got = op9_hilbert_sharding(spark, "/root/testdata/sf0.001").collect()
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == {k: (len(t) + 1, zlib.crc32(t)) for k, t in docs.items()}
    counts = Counter(r["shard"] for r in got)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    out = hilbert_shards(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), ["source", "lang", "n_chars"], shards=4)
    write_shards(out, f"file://{tmp_path}/shards")
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {k: t.decode() for k, t in docs.items()} and back.select("shard").distinct().count() == 4
    with pytest.raises(ValueError):
        hilbert_shards(out, [], shards=4)
    with pytest.raises(ValueError):
        hilbert_shards(out, ["lang"], law="bytes")


def test_strings_are_compared_whole(spark):
    """Sources with a long beginning in common are told apart: each is in few shards."""
    rows = [(i, f"https://site{i % 50:02d}.org") for i in range(2000)]
    got = hilbert_shards(spark.createDataFrame(rows, "doc_id long, source string").repartition(3), ["source", "doc_id"], shards=8).collect()
    shards = {}
    for r in got:
        shards.setdefault(r["source"], set()).add(r["shard"])
    assert sum(map(len, shards.values())) / 50 < 4


def test_bounds_of_strings_come_from_all_of_them(spark):
    """Cells of 5000 distinct strings, one in a third of the rows, are those of a plain pass over all counts."""
    counts = {f"source{i:04d}".encode(): 1 + i % 3 for i in range(5000)} | {b"source1000": 5000}
    whole, run, bounds = sum(counts.values()), 0, []
    for v, n in sorted(counts.items())[:-1]:
        run += n
        if run * 32 >= whole * (len(bounds) + 1):
            bounds.append(v)
    df = spark.createDataFrame([(v.decode(), n) for v, n in counts.items()], "source string, n int").selectExpr("source", "explode(sequence(1, n)) as i")
    got = hilbert_shards(df.repartition(3), ["source"], bits=5).select("source", "curve").distinct().collect()
    assert len(bounds) == 31 and len(got) == 5000
    assert {r["source"].encode(): r["curve"] for r in got} == {v: bisect.bisect_left(bounds, v) for v in counts}
