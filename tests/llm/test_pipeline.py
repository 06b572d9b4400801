import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from quern.llm.decontaminate import plain
from quern.llm.quality import fit, statistics
from quern.llm.queries import tokenizer_path
from test_dedup import brute_near
from test_leaks_mixing import least_distance

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = [plain(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    seen = []
    for name, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, SF)
        if name != "tokens":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen.append(docs)
    ids = [sorted(r["doc_id"] for r in d.select("doc_id").collect()) for d in seen]

    known = [i for i in rows if i in labels and zlib.crc32(str(i).encode()) % 4 != 2]
    x, y = statistics([rows[i] for i in known]), np.array([labels[i] for i in known])
    own = [x[y == c] for c in (0, 1)]
    model = fit(np.array([float(len(o)) for o in own]), np.stack([o.sum(0) for o in own]), np.stack([o.T @ o for o in own]))
    score = dict(zip(rows, model.score(statistics(list(rows.values())))))
    assert ids[0] == sorted(i for i in rows if score[i] >= 0.7)

    first = [i for i, _, _, kept in brute_near([(i, rows[i]) for i in ids[0]], 5, 80) if kept]
    assert ids[1] == sorted(first)

    leaked = {i for i in first for x in items if x in plain(rows[i]) or (x[:19] in plain(rows[i]) and least_distance(x, plain(rows[i])) <= len(x) // 20)}
    assert ids[2] == sorted(set(first) - leaked) and leaked

    assert set(ids[3]) == set(ids[2]) and max(Counter(ids[3]).values()) <= 2
    code = Tokenizer.from_file(tokenizer_path())
    want = [(i, code.encode(rows[i], add_special_tokens=False).ids + [0]) for i in ids[3]]
    got = sorted(seen[4].collect(), key=lambda r: r["start"])
    start = 0
    for r, (i, own) in zip(got, want, strict=True):
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        start += len(own)


def test_run_writes_and_reads_each_stage(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.filter(F.col("n_tokens") < 1).count() == 0
