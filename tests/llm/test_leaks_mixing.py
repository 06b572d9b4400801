import math
import random
import re
from collections import Counter, defaultdict

import pytest
from quern.llm import decontaminate
from quern.llm.decontaminate import Pattern, clean, contaminated, plain
from quern.llm.mixing import entropy, mix, plan, weights

DOCS = "doc_id long, text string, source string, block string, distance int"


def least_distance(item, text):
    """Sellers' dynamic programme, row by row."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(item, 1):
            new.append(min(row[i - 1] + (p != c), row[i] + 1, new[i - 1] + 1))
        row, best = new, min(best, new[-1])
    return best


def test_bit_parallel_distance_equals_the_dynamic_programme():
    rng = random.Random(3)
    for _ in range(300):
        item = "".join(rng.choices("abc ", k=rng.randint(1, 90)))
        text = "".join(rng.choices("abc ", k=rng.randint(0, 120)))
        assert Pattern(item).best(text)[0] == least_distance(item, text)


def test_contaminated_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    letters = "abcdefgh é\n"
    items = [(i, "".join(rng.choices(letters, k=rng.choice([1, 5, 19, 20, 45, 130])))) for i in range(12)] + [(50, ""), (51, None), (None, "abc"), (3, "another text of three")]
    rows = []
    for i in range(60):
        text = "".join(rng.choices(letters, k=rng.randint(0, 150)))
        if i % 2:
            item = list(rng.choice(items[:12])[1])
            for _ in range(rng.randint(0, max(1, len(item) // 15))):
                item[rng.randrange(len(item))] = rng.choice(["", "x", "yz", "A"])
            text = text[:40] + "".join(item).upper() + text[40:]
        rows.append((i, text, "s", "b", 0))
    rows += [(100, None, None, None, None), (None, "ANOTHER  text of three", None, None, None), (7, "another text of three", None, None, None)]
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")
    want = Counter()
    for k, t, *_ in rows:
        for n, x in items:
            if n is not None and plain(x):
                d = least_distance(plain(x), plain(t))
                if d <= int(len(plain(x)) * 0.1):
                    want[k, n, d] += 1
    for limit in (4_000_000, 100):
        monkeypatch.setattr(decontaminate, "BLOCK_CHARS", limit)
        got = contaminated(docs.repartition(3), bench, rate=0.1).collect()
        assert Counter((r["doc_id"], r["item_id"], r["distance"]) for r in got) == want
        kept = clean(docs, bench, rate=0.1)
        assert kept.columns == docs.columns
        bad = {k for k, _, _ in want}
        assert Counter(map(tuple, kept.collect())) == Counter(r for r in rows if r[0] not in bad or (r[0] == 7 and r[1] != "another text of three" and 7 not in bad))
    assert contaminated(docs, bench.limit(0)).collect() == [] and contaminated(docs.limit(0), bench).collect() == []


def test_spans_hold_the_match(spark):
    docs = spark.createDataFrame([(1, "Before   it: The answer\nis forty-two, they say. After", "s", "b", 0)], DOCS)
    hit = contaminated(docs, spark.createDataFrame([(9, "the answer is forty two, they say")], "item_id long, text string"), rate=0.05).first()
    assert (hit["distance"], plain(docs.first()["text"])[hit["start"] : hit["stop"]]) == (1, "the answer is forty-two, they say")


def test_exponent_meets_entropy_or_the_limit():
    tokens = {"a": 1000, "b": 100, "c": 10, "none": 0}
    free = plan(tokens, 0.9, 1e9)
    assert math.isclose(entropy(free.weights), 0.9, abs_tol=1e-6) and free.exponent < 1
    held = plan(tokens, 0.9, 3.0)
    assert math.isclose(max(held.epochs.values()), 3.0, rel_tol=1e-6) and math.isclose(min(held.epochs.values()), 1.0)
    assert plan(tokens, 0.0, 1.0).exponent == 1.0 and plan({}, 0.5, 2).weights == {}
    assert math.isclose(sum(weights(tokens, 0.3).values()), 1)


@pytest.mark.parametrize("budget", [None, 3000])
def test_mix_meets_budgets_in_whole_documents(spark, budget):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), rng.choice(["big"] * 6 + ["small", None]), "clash", 0) for i in range(600)]
    rows += [(700, None, "silent", "clash", 0), (3, "a b c", "big", "x", 0), (3, "a b c", "big", "x", 0), (None, "q " * 30_000 if budget is None else "q", "big", "x", 0)]
    mixed, made = mix(spark.createDataFrame(rows, DOCS).repartition(3), target_entropy=0.9, max_repeats=2.5, budget=budget)
    assert mixed.columns == ["doc_id", "text", "source", "distance", "n_tokens", "pass", "block"]
    got = mixed.collect()
    own, most, have = defaultdict(int), defaultdict(int), defaultdict(int)
    for _, t, s, *_ in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        have[s] += n
        most[s] = max(most[s], n)
    for r in got:
        own[r["source"]] += r["n_tokens"]
    for s, e in made.epochs.items():
        name = s[1:] if s else None
        assert e * have[name] - 1e-6 <= own[name] + most[name] and own[name] <= e * have[name] + 2 * most[name] + 6, (s, e, have[name], own[name])
    seen = Counter((r["doc_id"], r["text"]) for r in got)
    if budget is None:
        assert set(seen) == {(r[0], r[1]) for r in rows}
    passes = defaultdict(list)
    for r in got:
        passes[r["doc_id"], r["text"]].append(r["pass"])
    assert all(sorted(p) == list(range(len(p))) for k, p in passes.items() if k[0] != 3)
    assert mix(spark.createDataFrame([], DOCS))[0].collect() == []


def test_repeated_rows_meet_the_budget_one_by_one(spark):
    rows = [(1, "w " * 10, "a", "clash", 0)] * 200 + [(2, "w " * 10, "b", "clash", 0)]
    mixed, made = mix(spark.createDataFrame(rows, DOCS).repartition(3), target_entropy=0.0, max_repeats=9.0, budget=3000)
    own = sum(r["n_tokens"] for r in mixed.collect() if r["source"] == "a")
    assert abs(own - made.epochs["=a"] * 2000) < 10
