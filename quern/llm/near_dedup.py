"""Near-dedup by MinHash with odd sketches.

A document is its set of word shingles. Equal sets are one class from the start. MinHash samples of a set
are banded into bucket keys, and folded into a parity bitmap (an odd sketch): the population count of the
XOR of two bitmaps tells how many samples differ, so most false pairs of a bucket go before their texts
are read. A second bitmap of the whole set gives a bound without error: two sets differ in no fewer
shingles than their bitmaps do in bits. Every pair that is left is confirmed on full sets.

Buckets are never expanded into all pairs. In a first round each member is held against a few pivots of its
bucket. Links give components; a pair that is already in one component needs no test. In a second round
what the pivots did not settle is settled exactly: where few members of a bucket are outside its largest component,
they are held against all. Where many are, as with texts that share a block but are not alike, the bucket
tells too little: its members meet by the rarest of their shingles instead. Of two sets that are alike enough, each has a
shingle of the other among its first n - ceil(n * percent / 100) + 1 in any one order of all shingles; in the
order of how many sets have them, what is common to many comes last and brings nobody together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .stage import Stage, small, tidy
from .tally import mix, tally

ROWS = 4  # samples in a band
SKETCH_WORDS = 8
SAMPLES = 160
PARITY_WORDS = 16
#: A pair at the threshold shares no band once in this many times.
MISS = 1e-6
#: Members outside a bucket's largest component that are held against all of the bucket.
FEW = 32
#: Ids up to this many, at 8 bytes each, are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000

_U = np.uint64
_rng = np.random.default_rng(20240229)
_XOR = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.int64).astype(_U)
_MUL = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.int64).astype(_U) | _U(1)
_STEP = _rng.integers(0, 1 << 63, 64, dtype=np.int64).astype(_U) | _U(1)


def shingles(text: str, k: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles; of fewer than k words, of the one sequence."""
    words = text.encode().lower().split()  # of bytes: A-Z, and [\x20\x09-\x0D]
    n = len(words)
    if not n:
        return np.empty(0, _U)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, n)
    k, out = min(k, n), _U(min(k, n))
    for i in range(k):
        out = mix(out + h[i : n - k + 1 + i] * _STEP[0])
    return np.unique(out)


def bands_for(threshold: float) -> int:
    return min(SAMPLES // ROWS, math.ceil(math.log(MISS) / math.log(1 - threshold**ROWS)))


def minhash(h: np.ndarray) -> np.ndarray:
    low = np.full(SAMPLES, ~_U(0))
    for at in range(0, len(h), 512):
        np.minimum(low, ((h[at : at + 512, None] ^ _XOR) * _MUL).min(0), out=low)
    return low


def odd_sketches(low: np.ndarray) -> np.ndarray:
    """(n, SKETCH_WORDS) parity bitmaps of (n, SAMPLES) samples: each sample flips one bit."""
    bit = mix(low + np.arange(SAMPLES, dtype=_U) * _STEP[1]) % _U(64 * SKETCH_WORDS)
    flat = (np.arange(len(low), dtype=np.int64)[:, None] * (64 * SKETCH_WORDS) + bit.astype(np.int64)).ravel()
    odd = (np.bincount(flat, minlength=len(low) * 64 * SKETCH_WORDS) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(len(low), -1), axis=1).view(np.int64)


def parity(h: np.ndarray) -> np.ndarray:
    """A parity bitmap of a set: each shingle flips one bit."""
    odd = np.bincount((h % _U(64 * PARITY_WORDS)).astype(np.int64), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def most_flips(threshold: float, margin: float = 0.2) -> int:
    """The population count of the XOR that is expected at a similarity of threshold - margin, about six deviations off."""
    bits, flips = 64 * SKETCH_WORDS, 2 * SAMPLES * (1 - max(0.0, threshold - margin))
    return math.floor(bits / 2 * (1 - (1 - 2 / bits) ** flips))


def _signatures(k: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            size, low, name = np.zeros(n, np.int64), np.zeros((n, SAMPLES), _U), []
            odd = np.zeros((n, PARITY_WORDS), np.int64)
            for i, t in enumerate(batch["text"]):
                h = shingles(t.as_py() or "", k)
                size[i] = len(h)
                low[i] = minhash(h)
                odd[i] = parity(h)
                name.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
            key = _U(0)
            banded = low[:, : bands * ROWS].reshape(n, bands, ROWS)
            for r in range(ROWS):
                key = mix(key * _STEP[2] + banded[:, :, r])
            key = mix(key + np.arange(bands, dtype=_U) * _STEP[3]).view(np.int64)
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(size), pa.array(name, pa.binary()), lists(key), lists(odd_sketches(low)), lists(odd)],
                names=["doc_id", "n_shingles", "class", "bands", "sketch", "parity"],
            )

    return run


def _sets(k: int):
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                sets = [shingles(t.as_py() or "", k).view(np.int64) for t in part["text"]]
                ends = np.cumsum([0] + [len(s) for s in sets])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *sets])))
                yield pa.RecordBatch.from_arrays([part["doc_id"], lists], names=["doc_id", "set"])

    return run


def _confirmed(pairs: DataFrame, docs: DataFrame, stage: Stage, name: str, n: int, k: int, percent: int) -> DataFrame:
    """Of the `n` pairs (a, b) those whose full sets meet 100 * intersection >= percent * union, as (u, v)."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = docs.join(F.broadcast(ids) if 2 * n <= BROADCAST_IDS else ids, docs["doc_id"] == F.col("id"), "left_semi")
    sets = stage.write(texts.mapInArrow(tidy(_sets(k)), "doc_id long, set array<long>"), f"{name}-sets")
    one = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("set").alias("sa")), "a")
    two = one.join(sets.select(F.col("doc_id").alias("b"), F.col("set").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    hit = two.filter(100 * both >= percent * (F.size("sa") + F.size("sb") - both))
    out = stage.write(hit.select(F.col("a").alias("u"), F.col("b").alias("v")), f"{name}-links", rows=n)
    stage.drop(f"{name}-sets")
    return out


def _open(members: DataFrame) -> DataFrame:
    """Of keys with several components: the largest one, and the number of members outside it."""
    by_root = members.groupBy("key", "root").agg(F.count("*").alias("c"))
    keys = by_root.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("most"), (F.sum("c") - F.max("c")).alias("outside"))
    return keys.filter("outside > 0")


def _several(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        yield batch["set"].flatten().to_numpy(zero_copy_only=False).view(_U)


def _counted(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    many = counts > 1
    return pa.RecordBatch.from_arrays([pa.array(keys[many].view(np.int64)), pa.array(counts[many].astype(np.int64))], names=["key", "sets"])


def _rarest(shared, percent: int):
    """Of each set the shingles that it meets others by, of those in several sets."""

    def run(batches):
        keys, sets = shared.value
        for batch in batches:
            reps, out = [], []
            for rep, h in zip(batch["doc_id"].to_pylist(), batch["set"]):
                h = np.asarray(h.values)
                at = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
                there = keys[at] == h if len(keys) else np.zeros(len(h), bool)
                first = len(h) - (len(h) * percent + 99) // 100 + 1 - int((~there).sum())
                if first > 0:
                    own = h[there][np.lexsort((h[there], sets[at[there]]))[:first]]
                    out.append(own)
                    reps.append(np.full(len(own), rep))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out)), pa.array(np.concatenate(reps))], names=["key", "rep"])

    return run


def _meetings(crowd: DataFrame, n: int, docs: DataFrame, stage: Stage, k: int, percent: int) -> DataFrame:
    """(key, rep, root): the shingles that `crowd` (`n` rows of rep, root) meets by, as keys.

    The order is that of the number of sets that have a shingle, then of its hash. Numbers over one go to every task up to
    BROADCAST_IDS of them; more are joined.
    """
    texts = docs.join(F.broadcast(crowd) if n <= BROADCAST_IDS else crowd, F.col("doc_id") == F.col("rep"), "left_semi")
    sets = stage.write(texts.mapInArrow(tidy(_sets(k)), "doc_id long, set array<long>").distinct(), "crowd-sets")
    several = stage.write(tally(sets.select("set"), _several, _counted, "key long, sets long"), "crowd-counts")
    if several.count() <= BROADCAST_IDS:
        got = several.toArrow().sort_by("key")
        shared = docs.sparkSession.sparkContext.broadcast(tuple(got[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("key", "sets")))
        return sets.mapInArrow(tidy(_rarest(shared, percent)), "key long, rep long").distinct().join(crowd, "rep").select("key", "rep", "root")
    own = sets.select(F.col("doc_id").alias("rep"), F.xxhash64("set").alias("which"), F.size("set").alias("n"), F.explode("set").alias("key"))
    one = Window.partitionBy("rep", "which")
    ranked = own.join(several, "key").withColumn("place", F.row_number().over(one.orderBy("sets", "key"))).withColumn("_several", F.count("*").over(one))
    first = F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)) + 1
    return ranked.filter(F.col("place") + F.col("n") - F.col("_several") <= first).select("key", "rep").distinct().join(crowd, "rep").select("key", "rep", "root")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", pivots: int = 4) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, kept.

    Two documents are linked when 100 * intersection >= percent * union of their sets of k-word shingles;
    component_id is the least doc_id of all that a document reaches, itself included.

    Nulls: a null text is empty; a document without words has the empty set and is linked with nothing. A
    null key is linked with nothing, has a null component_id and is kept. Repeated rows are equal members;
    rows of one key with different texts are linked by each of their texts. Extra columns are not read. An
    empty table gives an empty table.
    """
    threshold = percent / 100
    stage = Stage(docs.sparkSession, "near-dedup")
    docs = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    signed = stage.write(docs.mapInArrow(tidy(_signatures(k, bands_for(threshold))), "doc_id long, n_shingles long, class binary, bands array<long>, sketch array<long>, parity array<long>"), "signed")
    linkable = signed.filter("doc_id is not null and n_shingles > 0")
    # equal sets have equal signatures: the first of a class stands for it
    classes = linkable.groupBy("class").agg(F.min(F.struct("doc_id", "n_shingles", "bands", "sketch", "parity")).alias("x"))
    classes = stage.write(classes.select("class", F.col("x.doc_id").alias("rep"), F.col("x.n_shingles").alias("n"), "x.bands", "x.sketch", "x.parity"), "classes")
    members = classes.select("rep", F.explode("bands").alias("key"))

    buckets = members.groupBy("key").agg(
        F.count("*").alias("held"), *[(F.min("rep") if i == 0 else F.max("rep") if i == 1 else F.min_by("rep", F.xxhash64("rep", F.lit(i)))).alias(f"p{i}") for i in range(pivots)]
    )
    buckets = buckets.filter("held > 1").select("key", F.array_distinct(F.array(*[f"p{i}" for i in range(pivots)])).alias("pivot"))
    near = stage.hold(members.join(buckets, "key"))
    facts = classes.select("rep", "n", "sketch", "parity")

    def close(a: str, b: str):
        flips = lambda x, words: sum(F.bit_count(F.col(f"{x}{a}")[i].bitwiseXOR(F.col(f"{x}{b}")[i])) for i in range(words))
        sizes = 100 * F.least(f"n{a}", f"n{b}") >= percent * F.greatest(f"n{a}", f"n{b}")
        # 100 i >= p u, with sizes n and difference d = u - i: (100 + p) d <= (100 - p) (na + nb)
        differ = (100 + percent) * flips("q", PARITY_WORDS) <= (100 - percent) * (F.col(f"n{a}") + F.col(f"n{b}"))
        return sizes & (flips("s", SKETCH_WORDS) <= most_flips(threshold)) & differ

    fact = lambda side: facts.select(F.col("rep").alias(side), F.col("n").alias(f"n{side}"), F.col("sketch").alias(f"s{side}"), F.col("parity").alias(f"q{side}"))
    pairs = near.select("rep", F.explode("pivot").alias("p")).filter("rep <> p").select(F.least("rep", "p").alias("a"), F.greatest("rep", "p").alias("b")).distinct()
    pairs = pairs.join(fact("a"), "a").join(fact("b"), "b").filter(close("a", "b")).select("a", "b")
    pairs = stage.hold(pairs)
    links = _confirmed(pairs, docs, stage, "first", pairs.count(), k, percent)
    roots = components(links, stage, "c1")

    placed = stage.hold(near.select("key", "rep").join(roots, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("root", "rep").alias("root")))
    side = lambda t, s: t.select(F.col("key").alias(f"k{s}"), F.col("rep").alias(s), F.col("root").alias(f"r{s}"), F.col("n").alias(f"n{s}"), F.col("sketch").alias(f"s{s}"), F.col("parity").alias(f"q{s}"))

    def across(members: DataFrame, open_: DataFrame) -> DataFrame:
        """Pairs (a, b) of one key and different components: those outside the key's largest component, held against all."""
        rest = members.join(open_.select("key", "most"), "key").join(facts, "rep")
        pairs = side(rest.filter("root <> most"), "x").join(side(rest, "y"), (F.col("kx") == F.col("ky")) & (F.col("rx") != F.col("ry")) & close("x", "y"))
        return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    open_ = stage.hold(_open(placed))
    cross = across(placed, open_.filter(F.col("outside") <= FEW))
    crowd = stage.write(placed.join(open_.filter(F.col("outside") > FEW), "key", "left_semi").select("rep", "root").distinct(), "crowd")
    if n := crowd.count():
        meeting = stage.write(_meetings(crowd, n, docs, stage, k, percent), "meetings")
        # written first, so that Spark can split the join by a key that many have
        cross = cross.unionByName(across(meeting, stage.write(_open(meeting), "open"))).distinct()
    cross = stage.hold(cross.join(pairs, ["a", "b"], "left_anti"))
    if n := cross.count():
        links = links.unionByName(_confirmed(cross, docs, stage, "second", n, k, percent))
        roots = components(links, stage, "c2")
    stage.release()
    named = classes.select("class", "rep").join(roots, F.col("rep") == F.col("node"), "left").select("class", F.coalesce("root", "rep").alias("component"))
    out = signed.select("doc_id", "n_shingles", "class").join(named, "class", "left")
    own = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def keep_first(docs: DataFrame, **how) -> DataFrame:
    """The rows of `docs`, all columns as they are, that `near_duplicates` keeps: one document of each group."""
    stage = Stage(docs.sparkSession, "near-dedup-keep")
    gone = stage.write(near_duplicates(docs.select("doc_id", "text"), **how).filter(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    return docs.join(small(gone, BROADCAST_IDS), docs["doc_id"] == F.col("_gone"), "left_anti")
