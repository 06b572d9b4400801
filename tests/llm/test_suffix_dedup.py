import hashlib
import random

import numpy as np
import pytest
from quern.llm import suffix_dedup as module
from quern.llm.induced_sort import suffix_order
from quern.llm.suffix_dedup import suffix_dedup

DOCS = "doc_id long, text string, key long, side int, kept string"


@pytest.mark.parametrize("memory", [0, 200, 1 << 20])
def test_suffix_order_against_sorting(memory):
    rng = random.Random(memory)
    for _ in range(200):
        letters = rng.choice([b"a", b"ab", b"abc", bytes(range(256))])
        pieces = [bytes(rng.choices(letters, k=rng.randint(1, rng.choice([3, 12, 80])))) for _ in range(rng.randint(1, 8))]
        pieces += pieces[: rng.randint(0, 2)]
        depth = rng.choice([1, 3, 50])
        ends = np.cumsum([len(p) for p in pieces])
        of = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
        suffix = lambda i: pieces[of[i]][i - ends[of[i]] + len(pieces[of[i]]) :]
        seen = []
        for places, common in suffix_order(np.frombuffer(b"".join(pieces), np.uint8), ends, depth, memory):
            for k, (i, c) in enumerate(zip(places.tolist(), common.tolist())):
                if k:
                    a, b = suffix(seen[-1]), suffix(i)
                    assert a[:depth] >= b[:depth]
                    same = next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
                    assert min(same, depth) == min(c, depth)
                seen.append(i)
        assert sorted(seen) == list(range(ends[-1]))


def brute(rows, length):
    where = {}
    data = [(r[1] or "").encode() for r in rows]
    order = lambda k: (k is None, k or 0)
    for r, b in zip(rows, data):
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            where[s] = min(where.get(s, (True, 1)), order(r[0]))
    out = []
    for r, b in zip(rows, data):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if where[b[i : i + length]] < order(r[0]):
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((r[0], len(b), sum(gone), sum(g and not gone[i - 1] if i else g for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def made_up(n, seed, letters, passages=8):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choices(letters, k=k))
    shared = [word(rng.randint(30, 140)) for _ in range(passages)]
    rows = []
    for i in range(n):
        text = "".join(rng.choice([word(rng.randint(0, 60)), rng.choice(shared), rng.choice(shared)[rng.randint(0, 20) :]]) for _ in range(rng.randint(0, 6)))
        rows.append((i * 13 % 997 - 200, text, 0, 0, "x"))
    return rows + [(5000, None, 0, 0, None), (5001, "", 0, 0, None), (None, shared[0] + "é" * 60, 0, 0, None), (None, shared[0] + "é" * 60, 0, 0, None), (7000, shared[1], 0, 0, None), (7000, shared[1], 0, 0, None), (7000, shared[1] + shared[0], 0, 0, None)]


@pytest.mark.parametrize("letters, length", [("abcdefghij é", 50), ("ab", 50), ("a", 50), ("abc", 7)])
def test_suffix_dedup_against_all_strings(spark, monkeypatch, letters, length):
    for seed, limits in ((1, (1 << 20, 2_000_000, 8 << 20, 4 << 20)), (2, (500, 300, 600, 400))):
        for name, value in zip(("CHUNK", "PAIRS", "PIECES", "SORTED"), limits):
            monkeypatch.setattr(module, name, value)
        rows = made_up(120, seed, letters)
        got = suffix_dedup(spark.createDataFrame(rows, DOCS).repartition(3), length).drop("kept").collect()
        assert sorted(map(tuple, got), key=str) == brute(rows, length)


def test_kept_bytes_and_empty_table(spark):
    passage = "the same passage of more than fifty bytes, found in both of the documents."
    got = suffix_dedup(spark.createDataFrame([(2, "before " + passage + " after"), (1, passage)], "doc_id long, text string"), with_text=True).collect()
    assert {r["doc_id"]: bytes(r["kept"]).decode() for r in got} == {1: passage, 2: "before  after"}
    assert suffix_dedup(spark.createDataFrame([], DOCS)).collect() == []
    long = "x" * 300_000 + "".join(map(str, range(40_000)))
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup(spark.createDataFrame([(1, long), (2, "y" + long)], "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: len(long)}


def test_pieces_of_one_name_are_told_apart_by_their_bytes():
    data = np.frombuffer(b"aaaabbbbaaaacccccc", np.uint8)
    at, n = np.array([0, 4, 8, 12]), np.array([4, 4, 4, 6])
    key, named = np.zeros(4, np.uint64), np.zeros(4, np.uint64)
    module._tell_apart(data, at, n, key, named)
    assert named[0] == named[2] and len({int(x) for x in named}) == 3


def test_length_over_what_common_prefixes_hold_is_refused(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError):
        suffix_dedup(docs, length=254)
