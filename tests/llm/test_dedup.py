import hashlib
import random
import re
from collections import defaultdict

from quern.llm import near_dedup
from quern.llm.components import components
from quern.llm.exact_dedup import exact_dedup
from quern.llm.near_dedup import near_duplicates
from quern.llm.stage import Stage

DOCS = "doc_id long, text string, n int, p long, kept string"


def brute_sets(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute_near(rows, k, percent):
    sets = [brute_sets(t, k) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = defaultdict(lambda: float("inf"))
    for i, r in enumerate(rows):
        least[find(i)] = min(least[find(i)], r[0])
    return sorted((r[0], len(sets[i]), least[find(i)], r[0] == least[find(i)]) for i, r in enumerate(rows))


def made_up(n, seed, words=60, groups=12):
    rng = random.Random(seed)
    vocabulary = [f"w{i}É" for i in range(400)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randint(1, words))] for _ in range(groups)]
    rows = []
    for i in range(n):
        text = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            text[rng.randrange(len(text))] = rng.choice(vocabulary)
        rows.append((i * 7 % (n * 7 + 1), rng.choice([" ", "\n", "\t "]).join(text), i, i, "x"))
    return rows + [(100_001, "", 0, 0, None), (100_002, None, 0, 0, None), (100_003, " \n", 0, 0, None), (100_004, "One  Two", 0, 0, None), (100_005, "one two", 0, 0, None)]


def test_near_duplicates_against_all_pairs(spark):
    for k, percent, seed in ((3, 85, 1), (5, 80, 2), (1, 50, 3)):
        rows = made_up(250, seed)
        got = near_duplicates(spark.createDataFrame(rows, DOCS).repartition(3), k=k, percent=percent).collect()
        assert sorted(map(tuple, got)) == brute_near(rows, k, percent)


def test_near_duplicates_edges(spark):
    assert near_duplicates(spark.createDataFrame([], DOCS)).collect() == []
    rows = [(None, "a b c", 0, 0, None), (2, "a b c", 0, 0, None), (2, "a b c", 0, 0, None), (1, "A  b c", 0, 0, None), (9, "x " * 50_000, 0, 0, None)]
    got = sorted(map(tuple, near_duplicates(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert got == sorted([(None, 1, None, True), (2, 1, 1, False), (2, 1, 1, False), (1, 1, 1, True), (9, 1, 9, True)], key=str)


def test_one_hot_group_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(200)]
    rows = []
    for i in range(300):
        t = list(base)
        for _ in range(rng.randint(0, 8)):
            t[rng.randrange(200)] = f"n{rng.randrange(10_000)}"
        rows.append((i, " ".join(t), 0, 0, None))
    assert sorted(map(tuple, near_duplicates(spark.createDataFrame(rows, DOCS), k=3, percent=85).collect())) == brute_near(rows, 3, 85)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(2002, 2001), (2003, 2001), (5, 5), (None, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long"), Stage(spark, "t"), "c").collect()))
    want = {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(50)} | {2001: 2001, 2002: 2001, 2003: 2001}
    assert got == want


def test_exact_dedup_against_a_dictionary(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a b", "a  b", "a\tb", " a b", "A b", "", None, "c" * 200 + "1", "c" * 200 + "2", f"u{i}", "é"]), i, i, "x") for i in range(200)]
    rows += [(None, "a b", 0, 0, None), (3, "again", 0, 0, None), (3, "again", 0, 0, None), (None, "null only", 0, 0, None)]
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    ids = defaultdict(list)
    for k, t, *_ in rows:
        ids[norm(t)].append(k)
    want = []
    for k, t, *_ in rows:
        known = [x for x in ids[norm(t)] if x is not None]
        keep = min(known) if known else None
        want.append((k, keep, len(ids[norm(t)]), k == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    got = exact_dedup(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert exact_dedup(spark.createDataFrame([], DOCS)).collect() == []


def test_boilerplate_meets_by_its_own_shingles(spark, monkeypatch):
    """Many texts with a common block, few of them alike: found as by holding all against all, without all pairs."""
    monkeypatch.setattr(near_dedup, "FEW", 3)
    rng = random.Random(9)
    block = " ".join(f"b{i}" for i in range(100))
    rows = []
    for i in range(300):
        own = [f"w{rng.randint(0, 5000)}" for _ in range(40)]
        rows.append((i, f"{block} {' '.join(own)}"))
        if i % 10 == 0:
            own[rng.randrange(40)] = "changed"
            rows.append((1000 + i, f"{block} {' '.join(own)}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: set(near_dedup.shingles(t, 5).tolist()) for i, t in rows}
    want = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b])
            if a < b and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                want[b] = min(want[b], want[a])
    for limit in (near_dedup.BROADCAST_IDS, 10):  # numbers of sets broadcast, and joined
        monkeypatch.setattr(near_dedup, "BROADCAST_IDS", limit)
        got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()}
        assert got == want and sum(i != c for i, c in want.items()) == 30
