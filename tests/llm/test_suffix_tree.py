import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from quern.llm import suffix_tree
from quern.llm.stage import Stage
from quern.llm.suffix_tree import BITS, held_out, learn, score_texts

DOCS = "doc_id long, text string, score double, row long, n int"


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + [None]


def made_up(n=300, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        last, w, out = "b", "a", []
        for _ in range(rng.randint(0, 60)):
            out.append(w.upper() if rng.random() < 0.1 else w)
            last, w = w, "abcdé"[(len(last) + 3 * ord(last[0]) + ord(w[0])) % 5] if rng.random() < 0.9 else f"rare{rng.randint(0, 400)}"
        rows.append((i, rng.choice([" ", "\n", "  "]).join(out), 0.0, i, 0))
    return rows + [(1000, None, None, None, None), (1001, "", None, None, None), (None, "a b c", None, None, None), (3, "a b", None, None, None), (3, "a b", None, None, None), (1002, "never seen " * 3000, None, None, None)]


@pytest.fixture
def loose(monkeypatch):
    """A bound at which a small text has grams that are broadcast and others."""
    monkeypatch.setattr(suffix_tree, "HOT", 50)


def test_counts_and_base_against_plain_python(spark, loose):
    rows = made_up()
    got = score_texts(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(t for r in rows if not held(r[0]) for t in tokens(r[1]))
    n, v = sum(c.values()), len(c)
    want = sorted(
        (str(r[0]), held(r[0]), len(tokens(r[1])), sum(c[t] > 0 for t in tokens(r[1])), n, round(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in tokens(r[1])), 6)) for r in rows
    )
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    long_ones = [r for r in got if r["held_out"] and r["n_tokens"] > 20]
    assert sum(r["score"] for r in long_ones) > sum(r["base_score"] for r in long_ones)


def test_scores_against_a_walk_over_the_tree(spark, loose):
    """Each token looked up alone, in the longest state, from the learnt tree; states recounted from the texts."""
    rows = made_up(200, 2)
    docs = spark.createDataFrame(rows, DOCS).select("doc_id", "text")
    train = docs.filter(~held_out(F.col("doc_id")))
    tree, vocabulary = learn(train, Stage(spark, "t"))
    counts = {r["key"]: r["count"] for r in vocabulary.collect()}
    w = tree.words
    import xxhash

    key = lambda t: suffix_tree.END if t is None else xxhash.xxh3_64_intdigest(t.encode())
    sym = dict(zip(w.hash.tolist(), w.symbol.tolist()))
    symbol = lambda t: sym.get(key(t), 0)
    assert len(tree.depths) == 2 and all(len(s.context) for s in tree.depths)
    # what the tree holds is what the training texts have
    grams = [Counter(), Counter()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    for r in rows:
        if not held(r[0]):
            s = [w.end] + [symbol(t) for t in tokens(r[1])]
            for d in (1, 2):
                grams[d - 1].update(tuple(s[i - d : i + 1]) for i in range(d, len(s)))
    for d, states in enumerate(tree.depths, 1):
        for k, share in zip(states.entry.tolist(), states.share.tolist()):
            gram = tuple((k >> (BITS * i)) & ((1 << BITS) - 1) for i in range(d, -1, -1))
            total = sum(n for g, n in grams[d - 1].items() if g[:-1] == gram[:-1])
            assert abs(share - (grams[d - 1][gram] - suffix_tree.DISCOUNT) / total) < 0.02, gram
    states = [(dict(zip(s.context.tolist(), s.back.tolist())), dict(zip(s.entry.tolist(), s.share.tolist()))) for s in tree.depths]

    def probability(before, s):
        p = tree.unigram[s]
        for d, (context, entry) in enumerate(states, 1):
            k = 0
            for x in before[-d:]:
                k = k << BITS | x
            if len(before) >= d and k in context:
                p = entry.get(k << BITS | s, 0) + context[k] * p
        return p

    got = {}
    for r in score_texts(docs, depth=2).collect():
        got.setdefault(r["doc_id"], []).append(r["score"])  # of repeated ids several
    for i, text, *_ in rows[:60] + rows[-6:-4]:
        before, want = [w.end], 0.0
        for t in tokens(text):
            s = symbol(t)
            want += math.log10(probability(before, s))
            if s == 0:
                want += math.log10((counts.get(np.array([key(t)], np.uint64).view(np.int64)[0], 0) + 1) / (w.rare_tokens + w.rare_distinct + 1))
            before.append(s)
        assert min(abs(x - want) for x in got[i]) < 1e-6, i
    # every state's distribution sums to one
    for before in ([w.end], [1, 2], [3, 1], [2, 2], [0, 1]):
        assert abs(sum(probability(before, s) for s in range(len(tree.unigram))) - 1) < 1e-9


def test_empty_and_untrained(spark):
    assert score_texts(spark.createDataFrame([], DOCS)).collect() == []
    only = [r for r in made_up(30) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2]
    got = score_texts(spark.createDataFrame(only, DOCS)).collect()
    assert len(got) == len(only) and {r["train_tokens"] for r in got} == {0} and {r["n_known"] for r in got} == {0}


def test_minimums_are_counts_at_every_size(spark, monkeypatch):
    """What is seen often enough is held whatever share of all tokens it is, and what is broadcast changes no score."""
    rng = random.Random(5)
    rows = [(i, " ".join("gamma delta epsilon" if rng.random() < 0.02 else f"w{rng.randint(0, 3000)}" for _ in range(60)), 0.0, i, 0) for i in range(400)]
    docs = spark.createDataFrame(rows, DOCS).select("doc_id", "text")
    train = docs.filter(~held_out(F.col("doc_id")))
    scores = []
    for hot in (1e9, 50, 1e-9):  # nearly all, some and nothing broadcast
        monkeypatch.setattr(suffix_tree, "HOT", hot)
        scores.append({r["doc_id"]: r["score"] for r in score_texts(docs).collect()})
        tree = learn(train, Stage(spark, "t"))[0]
        w = tree.words
        import xxhash

        number = dict(zip(w.hash.tolist(), w.symbol.tolist()))
        gamma, delta, epsilon = (number[xxhash.xxh3_64_intdigest(x)] for x in (b"gamma", b"delta", b"epsilon"))
        assert len(w.hash) > 2900  # every word is a symbol
        assert gamma in tree.depths[0].context.tolist()
        assert (gamma << BITS | delta) in tree.depths[0].entry.tolist() and (delta << BITS | epsilon) in tree.depths[0].entry.tolist()
    for other in scores[1:]:
        assert all(abs(scores[0][i] - other[i]) < 1e-9 for i in scores[0])


def test_depth_is_not_bound_by_a_key(spark):
    """A word that only the third one back tells is scored better with three words of context."""
    rng = random.Random(6)
    rows = []
    for i in range(500):
        kind = rng.choice("pq")
        rows.append((i, f"{kind} one two {'left' if kind == 'p' else 'right'}", 0.0, i, 0))
    docs = spark.createDataFrame(rows, DOCS).select("doc_id", "text")
    two, three = ({r["doc_id"]: r["score"] for r in score_texts(docs, depth=d).collect()} for d in (2, 3))
    assert all(three[i] > two[i] + 0.2 for i in three)
    with pytest.raises(ValueError):
        learn(docs, Stage(spark, "t"), depth=3)
