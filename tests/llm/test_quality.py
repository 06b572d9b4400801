import random
import zlib

import numpy as np
from pyspark.sql import functions as F
from quern.llm.quality import classify, fit, keep_good, statistics

DOCS = "doc_id long, text string, score double, statistics string, quality int"


def made_up(n, seed=1):
    rng = random.Random(seed)
    words = ["the", "ration", "of", "tables", "is", "and", "Meres", "thing"]
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        text = " ".join(rng.choice(words) for _ in range(rng.randint(5, 200)))
        if not good:
            text = "".join(c + (rng.choice("#$%&@") if rng.random() < 0.2 else "") for c in text)
        rows.append((i, text, 0.0, "clash", 5))
        labels.append((i, int(good)))
    return rows, labels


def test_classify_against_plain_numpy(spark):
    rows, labels = made_up(400)
    rows += [(900, None, None, None, None), (901, "", None, None, None), (None, "the thing", None, None, None), (5, "word " * 40_000, None, None, None)]
    got = classify(spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(labels + [(None, 1), (7, None), (8, 3)], "doc_id long, quality int")).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    known = dict(labels)
    learnt = [(r[1] or "", known[r[0]]) for r in rows if r[0] in known and not held(r[0])]
    x, y = statistics([t for t, _ in learnt]), np.array([q for _, q in learnt])
    own = [x[y == c] for c in (0, 1)]
    model = fit(np.array([float(len(o)) for o in own]), np.stack([o.sum(0) for o in own]), np.stack([o.T @ o for o in own]))
    # scores by the density formula, with plain inverses
    want = model.score(statistics([r[1] or "" for r in rows]))
    assert len(got) == len(rows)
    got_of = sorted((str(r["doc_id"]), r["score"]) for r in got)
    for (a, s), (b, w) in zip(got_of, sorted((str(r[0]), v) for r, v in zip(rows, want))):
        assert a == b and abs(s - w) < 1e-6
    for r in got:
        assert r["held_out"] == held(r["doc_id"]) and r["predicted"] == (r["score"] >= 0.7)
    tested = [(r["predicted"], known[r["doc_id"]]) for r in got if r["doc_id"] in known and r["held_out"]]
    assert sum(a == b for a, b in tested) >= 0.97 * len(tested)


def test_density_difference_matches_direct_inverse():
    rng = np.random.default_rng(0)
    d = statistics(["a"]).shape[1]
    a, b = rng.normal(size=(300, d)), rng.normal(0.5, 2, size=(200, d))
    model = fit(np.array([300.0, 200]), np.stack([a.sum(0), b.sum(0)]), np.stack([a.T @ a, b.T @ b]))
    x = rng.normal(size=(5, d))
    log = []
    for c in (0, 1):
        cov = np.linalg.inv(model.whiten[c].T @ model.whiten[c])
        diff = x - model.mean[c]
        log.append(np.log([0.6, 0.4][c]) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", diff, np.linalg.inv(cov), diff))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(log[0] - log[1])))


def test_keep_good_keeps_columns_and_edges(spark):
    rows, labels = made_up(200, 2)
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int")
    kept = keep_good(docs, marks)
    assert kept.columns == docs.columns
    good = {r["doc_id"] for r in classify(docs, marks).filter("predicted = 1").collect()}
    assert {r["doc_id"] for r in kept.collect()} == good and kept.filter(F.col("statistics") != "clash").count() == 0
    empty = spark.createDataFrame([], DOCS)
    assert classify(empty, marks).collect() == [] and keep_good(empty, marks.limit(0)).collect() == []
    assert {r["score"] for r in classify(docs, marks.limit(0)).collect()} == {0.5}
