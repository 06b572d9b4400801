"""Language-model scores from a probabilistic suffix tree over words.

Symbols are all words and the end of a text. A context of up to `depth` symbols is a state of the tree if its
next-symbol distribution differs from that of its suffix by more than chance: count * divergence must pass the
chi-square bound for the number of its next symbols. A symbol is scored in the longest state that is a suffix
of what stands before it. Distributions are smoothed by absolute discounts that go to the suffix's
distribution, down to the add-one share of single words. The minimums are counts, the same at every size.

Texts are read once, as numbers of words by chunk: each chunk asks the buckets of its distinct words for
numbers and counts, and all later steps read the chunks. A gram (a context and its next symbol) lives in the bucket
of its last two symbols, and so do all longer grams that end alike: positions go there once to be counted and once
to be scored. What a bucket needs of a context that lives elsewhere it asks for by the context's key. Grams that
are common enough to weigh on one bucket are found by a sample: they are counted where they are read, their values are
broadcast, and what ends in them is dealt by one symbol more. The sample decides on the way of a position, never on
a count or a score. A text's score is a sum over its grams: a word brings its own share, a state what it gives
to its suffix, and a held gram the difference to that.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stage import Stage, parts, tidy
from .tally import mix, pack, unpack

#: Times that a next symbol must be seen to be held in a state.
HELD = 2
DISCOUNT = 0.75
#: Grams with more than 1 / HOT of a bucket's mean are dealt by one symbol more; so at most HOT * buckets a depth are broadcast.
HOT = 8
#: One in so many places is looked at for such grams, in at most so many chunks (a bound, and a matter of spread only).
SAMPLE, SAMPLE_CHUNKS = 8, 4096
#: Buckets a shuffle partition; they are worked on one after the other.
BUCKETS = 2
#: Keys that a bucket has for a group of contexts, about.
MESSAGE = 128
#: Bits of a symbol in the keys of a collected tree.
BITS = 21
_U = np.uint64
END = 0xE0D0E0D0E0D0E0D1  # the end's place among word hashes
_STEP = _U(0x9E3779B97F4A7C15)
_BACK = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PARTS = 1 << 24  # values of grams are whole parts of this
#: Bytes of text in a chunk (or one text), and parts in which positions are scored, one after the other: disk holds one part's at a time.
CHUNK, TURNS = 6 << 20, 2
TOGETHER = 256 << 10  # packed bytes of text places that are scored at once


def held_out(key: Column) -> Column:
    """Rows that nothing is learnt from: crc32 of the key as text is 2 modulo 7."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def codes(x: np.ndarray) -> bytes:
    """Integers from 0 in the fewest bytes that hold them, packed."""
    top = int(x.max()) if len(x) else 0
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return bytes([width]) + pack(x.astype(f"<u{width}"))


def decodes(data: bytes) -> np.ndarray:
    return unpack(data[1:], np.dtype(f"<u{data[0]}"))


def signed(x: np.ndarray) -> bytes:
    x = x.astype(np.int64)
    return codes(((x << 1) ^ (x >> 63)).view(_U))


def unsigned(data: bytes) -> np.ndarray:
    x = decodes(data).astype(np.int64)
    return (x >> 1) ^ -(x & 1)


def climbing(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys."""
    return pack(np.diff(keys, prepend=_U(0)))


def climbed(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, _U), dtype=_U)


def shares(x: np.ndarray) -> bytes:
    return pack(x.astype(np.float32).view(np.uint32))


def shared(data: bytes) -> np.ndarray:
    return unpack(data, np.uint32).view(np.float32).astype(np.float64)


def find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each key in a sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def batch_of(schema: pa.Schema, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


def sent(schema: pa.Schema, rows: Iterator[dict], size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows in batches of bounded bytes."""
    held, n = [], 0
    for r in rows:
        held.append(r)
        n += 64 + sum(len(v) for v in r.values() if isinstance(v, bytes))
        if n >= size:
            yield batch_of(schema, held)
            held, n = [], 0
    if held:
        yield batch_of(schema, held)


def runs_of(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows that stand together by an equal value."""
    value, rows = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if rows and r[by] != value:
                yield value, rows
                rows = []
            value = r[by]
            rows.append(r)
    if rows:
        yield value, rows


def bounds(of: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, from, to) of a sorted array."""
    names, first = np.unique(of, return_index=True)
    yield from zip(names.tolist(), first.tolist(), [*first[1:].tolist(), len(of)])


def ddl(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.float64(): "double", pa.list_(pa.int64()): "array<long>", pa.list_(pa.binary()): "array<binary>"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def exchange(df: DataFrame, to: str, *then: str) -> DataFrame:
    return df.repartition(parts(df.sparkSession), to).sortWithinPartitions(to, *then)


# --- texts as numbers -------------------------------------------------------------------------------------------

_b, _i, _l = pa.binary(), pa.int32(), pa.int64()
#: A chunk's texts (bucket is null), and what it asks each bucket of words: hashes and how often they are learnt from.
ENCODED = pa.schema([("bucket", _i), ("chunk", _l), ("keys", _b), ("counts", _b), ("doc_ids", pa.list_(_l)), ("sizes", _b), ("train", _b), ("index", _b)])
#: A bucket's answer to a chunk, and (chunk is null) its words and their counts.
ANSWER = pa.schema([("bucket", _i), ("chunk", _l), ("keys", _b), ("numbers", _b), ("totals", _b), ("tokens", _l), ("words", _l)])
#: A chunk: its words by number with their counts, what they give back as contexts (or NaN), its texts as places of words; `end` is the end's place.
CHUNKS = pa.schema([("chunk", _l), ("doc_ids", pa.list_(_l)), ("sizes", _b), ("train", _b), ("index", _b), ("numbers", _b), ("totals", _b), ("backs", _b), ("end", _l)])


def _encode(buckets: int):
    def encoded(name, ids, train, texts):
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        at, flat = split.offsets.to_numpy(), split.flatten().dictionary_encode()
        at = at - at[0]
        words, index = flat.dictionary.to_pylist(), flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        keys = np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, len(words))
        real = np.array([bool(w) for w in words], bool)[index] if words else np.empty(0, bool)
        of = np.repeat(np.arange(len(ids)), np.diff(at))[real]
        index = index[real]
        # an end after each text
        sizes = np.bincount(of, minlength=len(ids)) + 1
        out = np.full(int(sizes.sum()), len(words), np.int64)
        out[np.arange(len(index)) + of] = index
        known, place = np.unique(np.append(keys, _U(END)), return_inverse=True)
        out = place[out]
        used = np.bincount(out, minlength=len(known)) > 0
        known, out = known[used], (np.cumsum(used) - 1)[out]
        counts = np.bincount(out[np.repeat(train, sizes)], minlength=len(known))
        yield {"chunk": name, "doc_ids": ids, "sizes": codes(sizes), "train": codes(train.astype(np.uint8)), "index": codes(out)}
        bucket = (mix(known) % _U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        for b, lo, hi in bounds(bucket[order]):
            own = order[lo:hi]
            yield {"bucket": b, "chunk": name, "keys": climbing(known[own]), "counts": codes(counts[own])}

    def run(batches):
        name, held, size = TaskContext.get().partitionId() << 33, [], 0

        def close():
            texts = pa.concat_arrays([pc.fill_null(b["text"].cast(pa.large_string()), "") for b in held])
            return sent(ENCODED, encoded(name, [i for b in held for i in b["doc_id"].to_pylist()], np.concatenate([b["train"].to_numpy(zero_copy_only=False) for b in held]), texts))

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch["text"].nbytes
                if size >= CHUNK:
                    yield from close()
                    name, held, size = name + 1, [], 0
        if held:
            yield from close()

    return run


def _number(buckets: int):
    """Numbers for a bucket's words, small for common ones, and their counts in all."""

    def run(batches):
        for b, rows in runs_of(batches, "bucket"):
            keys = [climbed(r["keys"]) for r in rows]
            known, place = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(place, np.concatenate([decodes(r["counts"]) for r in rows]), len(known)).astype(np.int64)
            rank = np.empty(len(known), np.int64)
            rank[np.lexsort((known, -total))] = np.arange(len(known))
            number, ends = rank * buckets + b + 1, np.cumsum([len(k) for k in keys])

            def answers():
                for r, k, end in zip(rows, keys, ends.tolist()):
                    own = place[end - len(k) : end]
                    yield {"bucket": b, "chunk": r["chunk"], "keys": r["keys"], "numbers": codes(number[own]), "totals": codes(total[own])}
                yield {"bucket": b, "keys": climbing(known), "totals": codes(total), "numbers": codes(number), "tokens": int(total.sum()), "words": int((total > 0).sum())}

            yield from sent(ANSWER, answers())

    return run


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for name, got in runs_of(batches, "chunk"):
            text = got.pop()
            keys = np.concatenate([climbed(r["keys"]) for r in got])
            by_key = np.argsort(keys)
            number, total = (np.concatenate([decodes(r[c]).astype(np.int64) for r in got])[by_key] for c in ("numbers", "totals"))
            order = np.argsort(number)
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            yield {
                **{c: text[c] for c in ("chunk", "doc_ids", "sizes", "train")}, "index": codes(place[decodes(text["index"])]),
                "numbers": codes(np.diff(number[order], prepend=0)), "totals": codes(total[order]), "end": int(place[np.searchsorted(keys[by_key], _U(END))]),
            }

    yield from sent(CHUNKS, rows())


def _chunks(encoded: DataFrame, answers: DataFrame) -> DataFrame:
    """Chunks in CHUNKS: each one's answers meet its texts in one partition."""
    null = lambda kind: F.lit(None).cast(kind)
    asked = answers.filter("chunk is not null").select("chunk", F.lit(0).alias("side"), "keys", "numbers", "totals", *[null(t).alias(c) for c, t in (("doc_ids", "array<long>"), ("sizes", "binary"), ("train", "binary"), ("index", "binary"))])
    texts = encoded.filter("bucket is null").select("chunk", F.lit(1).alias("side"), *[null("binary").alias(c) for c in ("keys", "numbers", "totals")], "doc_ids", "sizes", "train", "index")
    return exchange(asked.union(texts), "chunk", "side").mapInArrow(tidy(_join), ddl(CHUNKS))


@dataclass
class Chunk:
    """Texts as places in the chunk's words. `number`, `total`, `back` and `hash` are of words, `end` is the end's place."""

    name: int
    doc_ids: list
    size: np.ndarray
    train: np.ndarray
    index: np.ndarray
    number: np.ndarray
    total: np.ndarray
    back: np.ndarray
    hash: np.ndarray
    end: int

    def only_train(self) -> Chunk:
        keep = np.repeat(self.train, self.size)
        return Chunk(self.name, [], self.size[self.train], self.train[self.train], self.index[keep], self.number, self.total, self.back, self.hash, self.end)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    for batch in batches:
        for r in batch.to_pylist():
            number = np.cumsum(decodes(r["numbers"]).astype(np.int64))
            back = shared(r["backs"]) if r["backs"] else np.full(len(number), np.nan)
            yield Chunk(r["chunk"], r["doc_ids"], decodes(r["sizes"]).astype(np.int64), decodes(r["train"]).astype(bool), decodes(r["index"]).astype(np.int32), number, decodes(r["totals"]).astype(np.int64), back, word_key(number), r["end"])


def word_group(number: np.ndarray, buckets: int, groups: int) -> np.ndarray:
    """Where a word as a context is decided on."""
    return (number - 1) % buckets % groups


def word_key(number: np.ndarray) -> np.ndarray:
    """The key of a word, by its number, as a context of its own."""
    return mix(number.astype(_U) + _STEP)


# --- grams ------------------------------------------------------------------------------------------------------


def _before(chunk: Chunk, depth: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The words back from each place by depth (from 1), as places in the chunk's words; and how many there are, the end before a text counted."""
    place = np.arange(len(chunk.index), dtype=np.int32) - np.repeat((np.cumsum(chunk.size) - chunk.size).astype(np.int32), chunk.size)
    out, end = [], np.int32(chunk.end)
    for d in range(1, depth + 1):
        back = np.concatenate([np.full(min(d, len(place)), end), chunk.index[: max(0, len(place) - d)]])
        out.append(np.where(place >= d, back, end))
    return out, place + 1


def _powers(depth: int) -> list:
    return [_U(pow(int(_STEP), d, 1 << 64)) for d in range(depth + 1)]


def _keys(chunk: Chunk, back: list[np.ndarray], depth: int | None = None) -> list[np.ndarray]:
    """Keys of the grams at each place by depth, from 1 to `depth`."""
    power, key, out = _powers(len(back)), chunk.hash[chunk.index], []
    for d, w in enumerate(back[:depth], 1):
        key = key + power[d] * chunk.hash[w]
        out.append(key)
    return out


def context_of(key: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The key of a gram's context, which is that of the context as a gram itself."""
    return (key - word_key(number)) * _BACK


HOT_ROWS = pa.schema([("depth", _i), ("key", _l), ("count", _l)])


def _sample(depth: int, share: float):
    """Grams that are common in the sampled places of a chunk."""

    def run(batches):
        for chunk in _read(batches):
            back, there = _before(chunk, depth)
            own = np.flatnonzero(np.arange(len(there)) % SAMPLE == chunk.name % SAMPLE)
            for d, key in enumerate(_keys(chunk, back), 1):
                key, n = np.unique(key[own[there[own] >= d]], return_counts=True)
                many = n >= max(2, share * len(own) / 2)
                if many.any():
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(many.sum(), d), _i), pa.array(key[many].view(np.int64)), pa.array(n[many])], schema=HOT_ROWS)
            yield pa.RecordBatch.from_arrays([pa.array([0], _i), pa.array([0], _l), pa.array([len(own)], _l)], schema=HOT_ROWS)

    return run


def _hot(chunks: DataFrame, stage: Stage, depth: int, buckets: int) -> list[np.ndarray]:
    """By depth the sorted keys of grams over 1 / (HOT * buckets) of the sampled places: at most HOT * buckets each."""
    share = 1 / (HOT * buckets)
    got = stage.write(chunks.mapInArrow(tidy(_sample(depth, share)), ddl(HOT_ROWS)), "sample").groupBy("depth", "key").agg(F.sum("count").alias("count"))
    n = got.filter("depth = 0").first()
    rows = got.filter("depth > 0").filter(F.col("count") >= share * n["count"]).select("depth", "key").collect() if n else []
    stage.drop("sample")
    hot = [np.array(sorted(r["key"] % (1 << 64) for r in rows if r["depth"] == d), _U) for d in range(1, depth + 1)]
    return hot


def _way(keys: list[np.ndarray], there: np.ndarray, hot: list[np.ndarray], buckets: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The least depth at which a place's gram isn't hot (depth + 1: none), and the bucket of that gram."""
    least = np.ones(len(there), np.int8)
    home = (mix(keys[0]) % _U(buckets)).astype(np.int64)
    on = np.arange(len(there))
    for d in range(1, len(keys) + 1):
        on = on[find(hot[d - 1], keys[d - 1][on])[1]]
        if not len(on):
            break
        least[on] = d + 1
        if d < depth:
            ends = there[on] < d + 1
            least[on[ends]] = depth + 1
            on = on[~ends]
            home[on] = (mix(keys[d][on]) % _U(buckets)).astype(np.int64)
    return least, home


#: Positions of one bucket from one chunk: words of last pairs and their counts; runs of one last pair (the last word, the one before, the run's length); words further back (0: none), the least depth, the text's place in the chunk.
POSITIONS = pa.schema([("bucket", _i), ("chunk", _l), ("words", _b), ("totals", _b), ("x", _b), ("w", _b), ("runs", _b), ("far", pa.list_(_b)), ("least", _b), ("row", _b), ("own", _b)])


def _positions(chunk: Chunk, depth: int, hot: list[np.ndarray], buckets: int, turn: int | None) -> tuple[Iterator[dict], list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """Rows of POSITIONS; and the keys by depth, the depths there are, and the words back."""
    back, there = _before(chunk, depth)
    # a depth beyond the last with hot grams needs no keys here, but for where its grams go
    keys = _keys(chunk, back, min(depth, 1 + max((d for d, h in enumerate(hot, 1) if len(h)), default=0)))
    least, home = _way(keys, there, hot, buckets, depth)

    def parcels():
        go = np.flatnonzero((least <= depth) if turn is None else (least <= depth) & (home % TURNS == turn))
        x, w, n = chunk.index[go].astype(np.int64), back[0][go].astype(np.int64), len(chunk.number)
        order = np.argsort((home[go] * n + w) * n + x) if buckets * n * n < 1 << 63 else np.lexsort((x, w, home[go]))
        x, w, order = x[order], w[order], go[order]
        of = None if turn is None else np.repeat(np.arange(len(chunk.size)), chunk.size)[order]
        far = [np.where(there[order] >= d, chunk.number[back[d - 1][order]], 0) for d in range(2, depth + 1)]
        for b, lo, hi in bounds(home[order]):
            first = lo + np.flatnonzero(np.concatenate([[True], (x[lo + 1 : hi] != x[lo : hi - 1]) | (w[lo + 1 : hi] != w[lo : hi - 1])]))
            used = np.zeros(n, bool)
            used[x[first]] = used[w[first]] = True
            own, place = np.flatnonzero(used), np.cumsum(used) - 1
            yield {
                "bucket": b, "chunk": chunk.name, "words": codes(np.diff(chunk.number[own], prepend=0)), "totals": codes(chunk.total[own]), "x": codes(place[x[first]]), "w": codes(np.diff(place[w[first]], prepend=0)),
                "runs": codes(np.diff(np.append(first, hi))), "far": [codes(f[lo:hi]) for f in far], "least": codes(least[order[lo:hi]]), "row": None if of is None else codes(of[lo:hi]),
            }

    return parcels(), keys, there, back


@dataclass
class Held:
    """Positions of a bucket put together again: each one's run, facts of runs, keys of positions."""

    run: np.ndarray
    least: np.ndarray
    x: np.ndarray
    w: np.ndarray
    tx: np.ndarray
    tw: np.ndarray
    key: list[np.ndarray]
    valid: list[np.ndarray]  # of the depth, and counted in this bucket


def _together(rows: list[dict], depth: int) -> Held:
    xs, ws, txs, tws, runs = [], [], [], [], []
    for r in rows:
        word, total = np.cumsum(decodes(r["words"]).astype(np.int64)), decodes(r["totals"]).astype(np.int64)
        x, w = decodes(r["x"]).astype(np.int64), np.cumsum(decodes(r["w"]).astype(np.int64))
        for out, v in ((xs, word[x]), (ws, word[w]), (txs, total[x]), (tws, total[w]), (runs, decodes(r["runs"]).astype(np.int64))):
            out.append(v)
    x, w, tx, tw, runs = (np.concatenate(v) for v in (xs, ws, txs, tws, runs))
    least = np.concatenate([decodes(r["least"]) for r in rows])
    power = _powers(depth)
    key = [np.repeat(word_key(x) + power[1] * word_key(w), runs)]
    valid = [least <= 1]
    for d in range(2, depth + 1):
        far = np.concatenate([decodes(r["far"][d - 2]).astype(np.int64) for r in rows])
        key.append(key[-1] + power[d] * word_key(far))
        valid.append((least <= d) & (far > 0))
    return Held(np.repeat(np.arange(len(runs)), runs), least, x, w, tx, tw, key, valid)


#: Held grams of a bucket, by depth: sorted keys, counts, last words, places of their suffixes (from the bucket's number of shorter grams on: of hot ones). Of depth 1: counts of the last word and of the one before, and that one's number.
COUNTS = pa.schema([("bucket", _i), ("keys", pa.list_(_b)), ("counts", pa.list_(_b)), ("last", pa.list_(_b)), ("parent", pa.list_(_b)), ("tx", pa.list_(_b)), ("tw", pa.list_(_b)), ("w", pa.list_(_b)), ("held", _l)])


def _learn(depth: int, buckets: int, common):
    """Positions of training texts by bucket; counts of hot grams go to the bucket after the last."""

    def run(batches):
        hot = common.value
        counts = [np.zeros(len(h), np.int64) for h in hot]
        facts = [np.zeros((5, len(h)), np.int64) for h in hot]  # last word, its count, count of the word before, suffix, the word before

        def rows():
            for chunk in _read(batches):
                chunk = chunk.only_train()
                parcels, keys, there, back = _positions(chunk, depth, hot, buckets, None)
                yield from parcels
                for d in range(len(keys)):
                    own = np.flatnonzero(there >= d + 1)
                    at, hit = find(hot[d], keys[d][own])
                    at, own = at[hit], own[hit]
                    counts[d] += np.bincount(at, minlength=len(hot[d]))
                    facts[d][:, at] = chunk.number[chunk.index[own]], chunk.total[chunk.index[own]], chunk.total[back[0][own]], find(hot[d - 1], keys[d - 1][own])[0] if d else np.zeros(len(own), np.int64), chunk.number[back[0][own]]
            for d in range(depth):
                if counts[d].any():
                    own = np.flatnonzero(counts[d])
                    yield {"bucket": buckets, "least": bytes([d]), "own": codes(own), "row": codes(counts[d][own]), "far": [codes(f[own]) for f in facts[d]]}

        yield from sent(POSITIONS, rows())

    return run


def _count(depth: int, buckets: int, common):
    def run(batches):
        hot = common.value
        for b, rows in runs_of(batches, "bucket"):
            table = []
            if b == buckets:
                for d in range(depth):
                    n, facts = np.zeros(len(hot[d]), np.int64), np.zeros((5, len(hot[d])), np.int64)
                    for r in rows:
                        if r["least"][0] == d:
                            own = decodes(r["own"]).astype(np.int64)
                            n[own] += decodes(r["row"]).astype(np.int64)
                            facts[:, own] = [decodes(f) for f in r["far"]]
                    table.append((hot[d], n, *facts))
            else:
                held = _together(rows, depth)
                before, may = np.empty(0, _U), np.ones(len(held.run), bool)
                for d in range(depth):
                    # a gram that is held has a suffix that is held, here or among the hot ones
                    own = np.flatnonzero(held.valid[d] & may)
                    order = np.argsort(held.key[d][own])
                    key = held.key[d][own[order]]
                    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
                    n = np.diff(np.append(first, len(key)))
                    many = n >= HELD
                    may = held.least > d + 1
                    may[own[order[np.repeat(many, n)]]] = True
                    key, first, n = key[first[many]], own[order[first[many]]], n[many]
                    parent = np.zeros(len(key), np.int64)
                    if d:
                        parent, local = find(before, held.key[d - 1][first])
                        parent = np.where(local, parent, len(before) + find(hot[d - 1], held.key[d - 1][first])[0])
                    run = held.run[first]
                    table.append((key, n, held.x[run], held.tx[run], held.tw[run], parent, held.w[run]))
                    before = key
            yield batch_of(COUNTS, [{
                "bucket": b, "keys": [climbing(t[0]) for t in table], "counts": [codes(t[1]) for t in table], "last": [codes(t[2]) for t in table],
                "parent": [codes(t[5]) for t in table], "tx": [codes(t[3]) for t in table[:1]], "tw": [codes(t[4]) for t in table[:1]], "w": [codes(t[6]) for t in table[:1]], "held": sum(len(t[0]) for t in table),
            }])

    return run


@dataclass
class Grams:
    key: np.ndarray
    n: np.ndarray
    last: np.ndarray
    parent: np.ndarray
    context: np.ndarray


def _grams(row: dict) -> tuple[list[Grams], np.ndarray, np.ndarray]:
    """A row of COUNTS by depth, and the counts of the last word and the one before of depth 1."""
    out = []
    for keys, counts, last, parent in zip(row["keys"], row["counts"], row["last"], row["parent"]):
        key, last = climbed(keys), decodes(last).astype(np.int64)
        out.append(Grams(key, decodes(counts).astype(np.int64), last, decodes(parent).astype(np.int64), context_of(key, last)))
    return out, decodes(row["tx"][0]).astype(np.int64), decodes(row["tw"][0]).astype(np.int64)


# --- states -----------------------------------------------------------------------------------------------------

#: To the group (`bucket`) of a context's key: sums over its next symbols (kind 0), or its own count and its suffix's as it is held at home (kind 1).
STATS = pa.schema([("bucket", _i), ("depth", _i), ("kind", _i), ("home", _i), ("keys", _b), ("total", _b), ("sums", _b), ("held", _b), ("parents", _b), ("distinct", _b)])
#: To the home bucket of grams: their contexts' counts and backs (kind 0), their own backs as contexts (kind 1); for a word's group its back (kind 2).
STATES = pa.schema([("bucket", _i), ("depth", _i), ("kind", _i), ("keys", _b), ("total", _b), ("backs", _b)])


def _stats(depth: int, buckets: int, groups: int, common):
    """What a bucket knows of contexts. Of words as contexts, to the words' own bucket."""

    def run(batches):
        hot_counts = common.value

        def rows():
            for batch in batches:
                for r in batch.to_pylist():
                    grams, tx, tw = _grams(r)
                    suffix = None
                    for d, g in enumerate(grams, 1):
                        before = tx if d == 1 else np.concatenate([grams[d - 2].n, hot_counts[d - 2]])[g.parent]
                        on = g.n >= HELD
                        order = np.flatnonzero(on)[np.argsort(g.context[on], kind="stable")]
                        c, first = np.unique(g.context[order], return_index=True)
                        add = lambda v: np.add.reduceat(v, first) if len(first) else v[:0]
                        n, s = g.n[order].astype(np.float64), before[order].astype(np.float64)
                        sums, held, parents = add(n * np.log(n / s)), add(g.n[order]), add(before[order])
                        distinct, total = np.diff(np.append(first, len(order))), tw[order[first]] if d == 1 else np.zeros(len(c), np.int64)
                        to = word_group(decodes(r["w"][0]).astype(np.int64)[order[first]], buckets, groups) if d == 1 else (mix(c) % _U(groups)).astype(np.int64)
                        by = np.argsort(to, kind="stable")
                        for b, lo, hi in bounds(to[by]):
                            o = by[lo:hi]
                            yield {"bucket": b, "depth": d, "kind": 0, "home": r["bucket"], "keys": climbing(c[o]), "total": codes(total[o]), "sums": sums[o].tobytes(), "held": codes(held[o]), "parents": codes(parents[o]), "distinct": codes(distinct[o])}
                        if d < depth:
                            to = (mix(g.key) % _U(groups)).astype(np.int64)
                            by = np.argsort(to, kind="stable")
                            by = by[on[by]]
                            for b, lo, hi in bounds(to[by]):
                                o = by[lo:hi]
                                yield {"bucket": b, "depth": d + 1, "kind": 1, "home": r["bucket"], "keys": climbing(g.key[o]), "total": codes(g.n[o]), "parents": codes(before[o])}

        yield from sent(STATS, rows())

    return run


def bound(symbols: np.ndarray) -> np.ndarray:
    """About half the 95 % point of chi-square with so many degrees of freedom."""
    return 0.5 * (symbols + 2.33 * np.sqrt(symbols) + 0.5)


def _decide(buckets: int, tokens: int):
    """States and what they give back; answers to all homes that asked."""

    def run(batches):
        def rows():
            for b, got in runs_of(batches, "bucket"):
                for d in sorted({r["depth"] for r in got}):
                    asked = [r for r in got if r["depth"] == d and r["kind"] == 0]
                    own = [r for r in got if r["depth"] == d and r["kind"] == 1]
                    if not asked:
                        continue
                    keys = [climbed(r["keys"]) for r in asked]
                    c, place = np.unique(np.concatenate(keys), return_inverse=True)
                    add = lambda parts_: np.bincount(place, np.concatenate(parts_), len(c))
                    sums = add([np.frombuffer(r["sums"], np.float64) for r in asked])
                    held, parents, distinct = (add([decodes(r[name]) for r in asked]) for name in ("held", "parents", "distinct"))
                    total, above = np.zeros(len(c)), np.full(len(c), float(tokens))
                    if d == 1:
                        total[place] = np.concatenate([decodes(r["total"]) for r in asked])
                    for r in own:
                        at, there = find(c, climbed(r["keys"]))
                        total[at[there]], above[at[there]] = decodes(r["total"])[there], decodes(r["parents"])[there]
                    with np.errstate(divide="ignore", invalid="ignore"):
                        # what a context's unheld symbols have in all is compared as one symbol, which can only lessen the divergence
                        rest, rest_above = total - held, np.maximum(above - parents, 1e-9)
                        divergence = sums - held * np.log(total / above) + np.where(rest > 0, rest * np.log(rest / total * above / rest_above), 0.0)
                        state = (total >= HELD) & (divergence > bound(distinct))
                        back = np.where(state, (rest + DISCOUNT * distinct) / total, np.nan)
                    for r, k in zip(asked, keys):
                        at = np.searchsorted(c, k)
                        on = state[at]
                        if on.any():
                            yield {"bucket": r["home"], "depth": d, "kind": 0, "keys": climbing(k[on]), "total": codes(total[at[on]].astype(np.int64)), "backs": shares(back[at[on]])}
                    for r in own:
                        k = climbed(r["keys"])
                        at, there = find(c, k)
                        on = there & state[at]
                        if on.any():
                            yield {"bucket": r["home"], "depth": d - 1, "kind": 1, "keys": climbing(k[on]), "backs": shares(back[at[on]])}
                    if d == 1 and state.any():
                        yield {"bucket": b, "depth": 0, "kind": 2, "keys": climbing(c[state]), "backs": shares(back[state])}

        yield from sent(STATES, rows())

    return run


#: What each held gram of a bucket adds to a score, by depth.
VALUES = pa.schema([("bucket", _i), ("keys", pa.list_(_b)), ("values", pa.list_(_b))])


def worth(row: dict, states: list[dict], hot_p: list[np.ndarray] | None, divisor: float) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """By depth the keys, values and probabilities of a bucket's grams. `hot_p` is None in the bucket of hot grams, whose suffixes are there."""
    grams, tx, _ = _grams(row)
    keys, values, likely = [], [], []

    def known(kind: int, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = [r for r in states if r["kind"] == kind and r["depth"] == d]
        key = np.concatenate([np.empty(0, _U), *(climbed(r["keys"]) for r in own)])
        order = np.argsort(key)
        total = np.concatenate([np.empty(0, np.int64), *(decodes(r["total"]).astype(np.int64) if kind == 0 else np.empty(0, np.int64) for r in own)])
        back = np.concatenate([np.empty(0), *(shared(r["backs"]) for r in own)])
        return key[order], total[order] if kind == 0 else total, back[order]

    for d, g in enumerate(grams, 1):
        parent = (tx + 1) / divisor if d == 1 else (likely[-1] if hot_p is None else np.concatenate([likely[-1], hot_p[d - 2]]))[g.parent]
        total, back, value = np.zeros(len(g.key)), np.full(len(g.key), np.nan), np.zeros(len(g.key))
        context, totals, backs = known(0, d)
        at, there = find(context, g.context)
        total[there], back[there] = totals[at[there]], backs[at[there]]
        as_context, _, backs = known(1, d)
        at, there = find(as_context, g.key)
        value[there] = np.log10(backs[at[there]])
        on = ~np.isnan(back) & (g.n >= HELD)
        p = parent.copy()
        p[on] = (g.n[on] - DISCOUNT) / total[on] + back[on] * parent[on]
        value[on] += np.log10(p[on]) - np.log10(back[on]) - np.log10(parent[on])
        keys.append(g.key)
        values.append(value)
        likely.append(p)
    return keys, values, likely


def _worths(common, divisor: float):
    def run(batches):
        hot_p = common.value
        for b, rows in runs_of(batches, "bucket"):
            counts = [r for r in rows if r["counts"] is not None]
            if not counts:
                continue
            keys, values, _ = worth(counts[0], [r | {"keys": r["keys"][0]} for r in rows if r["counts"] is None], hot_p, divisor)
            yield batch_of(VALUES, [{"bucket": b, "keys": [climbing(k) for k in keys], "values": [signed(np.rint(v * _PARTS)) for v in values]}])

    return run


# --- the tree and its scores --------------------------------------------------------------------------------------


@dataclass
class Tables:
    """The whole tree as written tables, and what is broadcast of it: keys, counts and values of hot grams by depth."""

    chunks: DataFrame
    vocabulary: DataFrame
    counts: DataFrame
    states: DataFrame
    values: DataFrame
    tokens: int
    distinct: int
    buckets: int
    groups: int
    hot: list[np.ndarray]
    hot_values: list[np.ndarray]

    @property
    def divisor(self) -> float:
        return float(self.tokens + self.distinct + 1)


def learn_tables(docs: DataFrame, stage: Stage, depth: int, look: bool = False) -> Tables:
    """From docs (doc_id, text, train), all of which are encoded and those of `train` learnt from; with the vocabulary if to `look` at."""
    if depth < 1:
        raise ValueError("a context has one symbol at least")
    spark = docs.sparkSession
    buckets = BUCKETS * parts(spark)
    encoded = stage.write(docs.mapInArrow(tidy(_encode(buckets)), ddl(ENCODED)), "encoded")
    asked = encoded.filter("bucket is not null").select("bucket", "chunk", "keys", "counts")
    answers = stage.write(exchange(asked, "bucket").mapInArrow(tidy(_number(buckets)), ddl(ANSWER)), "answers")
    whole = answers.filter("chunk is null").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    tokens, distinct = int(whole[0]), int(whole[1])
    chunks = stage.write(_chunks(encoded, answers), "chunks")
    vocabulary = stage.write(answers.filter("chunk is null").select("keys", "numbers", "totals"), "vocabulary") if look else answers
    stage.drop("encoded", "answers")
    stage.free()
    every = max(1, chunks.count() // SAMPLE_CHUNKS)
    hot = _hot(chunks.filter(F.pmod(F.xxhash64("chunk"), F.lit(every)) == 0), stage, depth, buckets)
    common = spark.sparkContext.broadcast(hot)
    counts = stage.write(exchange(chunks.mapInArrow(tidy(_learn(depth, buckets, common)), ddl(POSITIONS)), "bucket").mapInArrow(tidy(_count(depth, buckets, common)), ddl(COUNTS)), "counts")
    stage.free()
    hot_row = counts.filter(F.col("bucket") == buckets).first()  # at most HOT * buckets grams a depth
    hot_row = hot_row and hot_row.asDict()
    hot_counts = [g.n for g in _grams(hot_row)[0]] if hot_row else [np.zeros(len(h), np.int64) for h in hot]
    # so few that a message between a bucket and a group has some MESSAGE keys, else their number would be that of the buckets squared
    held = counts.agg(F.coalesce(F.sum("held"), F.lit(0)).alias("n")).first()["n"]
    groups = int(min(buckets, max(parts(spark) / 4, held / buckets / MESSAGE)) + 1)
    stats = counts.mapInArrow(tidy(_stats(depth, buckets, groups, spark.sparkContext.broadcast(hot_counts))), ddl(STATS))
    states = stage.write(exchange(stats, "bucket").mapInArrow(tidy(_decide(buckets, tokens)), ddl(STATES)), "states")
    del stats
    stage.free()
    tables = Tables(chunks, vocabulary, counts, states, counts, tokens, distinct, buckets, groups, hot, [np.zeros(len(h)) for h in hot])
    hot_p = [np.zeros(len(h)) for h in hot]
    if hot_row:
        own = [r.asDict() for r in states.filter((F.col("bucket") == buckets) & (F.col("kind") < 2)).collect()]
        _, values, hot_p = worth(hot_row, own, None, tables.divisor)
        tables.hot_values = [np.rint(v * _PARTS) / _PARTS for v in values]
    null = lambda c, kind: F.lit(None).cast(kind).alias(c)
    left = counts.filter(F.col("bucket") < buckets).select("bucket", null("depth", "int"), null("kind", "int"), "keys", "counts", "last", "parent", "tx", "tw", "w", null("total", "binary"), null("backs", "binary"))
    right = states.filter((F.col("bucket") < buckets) & (F.col("kind") < 2)).select("bucket", "depth", "kind", F.array("keys").alias("keys"), *[null(c, "array<binary>") for c in ("counts", "last", "parent", "tx", "tw", "w")], "total", "backs")
    common, values = spark.sparkContext.broadcast(hot_p), None
    for turn in range(TURNS):
        both = exchange(left.union(right).filter(F.col("bucket") % TURNS == turn), "bucket")
        own = stage.write(both.mapInArrow(tidy(_worths(common, tables.divisor)), ddl(VALUES)), f"values-{turn}")
        values = own if values is None else values.union(own)
        del both
        stage.free()
    tables.values = values
    return tables


#: A chunk's words of one bucket (numbers), or with chunk null a bucket's states among words; answered by numbers and backs.
BACKS = pa.schema([("bucket", _i), ("chunk", _l), ("numbers", _b), ("backs", _b)])


def _ask_backs(buckets: int, groups: int):
    def run(batches):
        def rows():
            for batch in batches:
                for r in batch.to_pylist():
                    number = np.cumsum(decodes(r["numbers"]).astype(np.int64))
                    bucket = word_group(number, buckets, groups)
                    order = np.argsort(bucket, kind="stable")
                    for b, lo, hi in bounds(bucket[order]):
                        yield {"bucket": b, "chunk": r["chunk"], "numbers": codes(np.diff(number[order[lo:hi]], prepend=0))}

        yield from sent(BACKS, rows())

    return run


def _give_backs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for _, got in runs_of(batches, "bucket"):
            states = [r for r in got if r["chunk"] is None]
            if not states:
                continue
            key, back = np.concatenate([climbed(r["numbers"]) for r in states]), np.concatenate([shared(r["backs"]) for r in states])
            order = np.argsort(key)
            key, back = key[order], back[order]
            for r in got:
                if r["chunk"] is not None:
                    number = np.cumsum(decodes(r["numbers"]).astype(np.int64))
                    at, there = find(key, word_key(number))
                    if there.any():
                        yield {"chunk": r["chunk"], "numbers": codes(np.diff(number[there], prepend=0)), "backs": shares(back[at[there]])}

    yield from sent(BACKS, rows())


def _take_backs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for _, got in runs_of(batches, "chunk"):
            chunk = got.pop()
            number = np.cumsum(decodes(chunk["numbers"]).astype(np.int64))
            back = np.full(len(number), np.nan)
            for r in got:
                back[np.searchsorted(number, np.cumsum(decodes(r["numbers"]).astype(np.int64)))] = shared(r["backs"])
            yield chunk | {"backs": shares(back)}

    yield from sent(CHUNKS, rows())


def _with_backs(tables: Tables) -> DataFrame:
    """Chunks with what their words give back as contexts."""
    null = lambda c, kind: F.lit(None).cast(kind).alias(c)
    asked = tables.chunks.select("chunk", "numbers").mapInArrow(tidy(_ask_backs(tables.buckets, tables.groups)), ddl(BACKS))
    states = tables.states.filter("kind = 2").select("bucket", null("chunk", "long"), F.col("keys").alias("numbers"), "backs")
    given = exchange(asked.union(states), "bucket").mapInArrow(tidy(_give_backs), ddl(BACKS))
    given = given.select("chunk", F.lit(0).alias("side"), *[F.col(f.name) if f.name in ("numbers", "backs") else null(f.name, ddl(pa.schema([f])).split()[1]) for f in CHUNKS if f.name != "chunk"])
    chunks = tables.chunks.select("chunk", F.lit(1).alias("side"), *[f.name for f in CHUNKS if f.name != "chunk"])
    return exchange(given.union(chunks), "chunk", "side").mapInArrow(tidy(_take_backs), ddl(CHUNKS))


#: Of a chunk: its texts' own sums, or a bucket's sums for texts by their place in the chunk.
SUMS = pa.schema([("chunk", _l), ("doc_ids", pa.list_(_l)), ("sizes", _b), ("known", _b), ("base", _b), ("tree", _b), ("row", _b), ("sums", _b)])
_PARCELS = pa.schema([*POSITIONS, *[f for f in SUMS if f.name not in ("chunk", "row")], ("keys", pa.list_(_b)), ("values", pa.list_(_b))])


def _ask(depth: int, buckets: int, common, turn: int):
    """Positions of all texts by bucket, and in the first turn each chunk's own sums: of words, and of hot grams."""

    def run(batches):
        hot, hot_values = common.value

        def rows():
            for chunk in _read(batches):
                parcels, keys, there, back = _positions(chunk, depth, hot, buckets, turn)
                yield from parcels
                del parcels
                if turn:
                    continue
                start = np.cumsum(chunk.size) - chunk.size
                base = np.log10(chunk.total + 1.0)[chunk.index]
                tree = base + np.nan_to_num(np.log10(chunk.back))[back[0]]
                for d in range(len(keys)):
                    own = np.flatnonzero(there >= d + 1)
                    at, hit = find(hot[d], keys[d][own])
                    tree[own[hit]] += hot_values[d][at[hit]]
                add = lambda v: np.add.reduceat(v, start)
                yield {"bucket": chunk.name % buckets, "chunk": chunk.name, "doc_ids": chunk.doc_ids, "sizes": codes(chunk.size), "known": codes(add((chunk.total[chunk.index] > 0).astype(np.int64))), "base": add(base).tobytes(), "tree": add(tree).tobytes()}

        yield from sent(_PARCELS, rows())

    return run


def _answer(depth: int):
    """Sums of a bucket's values for each text that has positions in it."""

    def run(batches):
        for _, rows in runs_of(batches, "bucket"):
            keys, values = [np.empty(0, _U)] * depth, [np.empty(0)] * depth
            for r in rows:
                if r["values"] is not None:
                    keys, values = [climbed(k) for k in r["keys"]], [unsigned(v) / _PARTS for v in r["values"]]

            def sums():
                held, size = [], 0
                for r in rows:
                    if r["sizes"] is not None:
                        yield {"chunk": r["chunk"], **{c: r[c] for c in ("doc_ids", "sizes", "known", "base", "tree")}}
                    elif r["row"] is not None:
                        held.append(r)
                        size += len(r["row"])
                        if size >= TOGETHER:
                            yield from met(held)
                            held, size = [], 0
                if held:
                    yield from met(held)

            def met(own):
                held = _together(own, depth)
                total = np.zeros(len(held.run))
                may = np.ones(len(held.run), bool)
                for d in range(depth):
                    # a gram is held only where its suffix is, here or among the hot ones
                    valid = np.flatnonzero(held.valid[d] & may)
                    at, there = find(keys[d], held.key[d][valid])
                    total[valid[there]] += values[d][at[there]]
                    may = held.least > d + 1
                    may[valid[there]] = True
                at = 0
                for r in own:
                    row = decodes(r["row"]).astype(np.int64)
                    sum_ = np.rint(np.bincount(row, total[at : at + len(row)]) * _PARTS).astype(np.int64)
                    at += len(row)
                    texts = np.flatnonzero(sum_)
                    yield {"chunk": r["chunk"], "row": codes(np.diff(texts, prepend=0)), "sums": signed(sum_[texts])}

            yield from sent(SUMS, sums())

    return run


SCORES = "doc_id long, n_tokens long, n_known long, base double, tree double"


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, rows in runs_of(batches, "chunk"):
        own = next(r for r in rows if r["sizes"] is not None)
        tree = np.frombuffer(own["tree"], np.float64).copy()
        for r in rows:
            if r["sums"] is not None:
                np.add.at(tree, np.cumsum(decodes(r["row"]).astype(np.int64)), unsigned(r["sums"]) / _PARTS)
        columns = [pa.array(own["doc_ids"], _l), decodes(own["sizes"]).astype(np.int64), decodes(own["known"]).astype(np.int64), np.frombuffer(own["base"], np.float64), tree]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in SCORES.split(", ")])


def score_texts(docs: DataFrame, depth: int = 3) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows that aren't held out and scores all whole texts.

    Nulls: a null text is empty and has the end as its one token; a null id is learnt from. Repeated rows
    count and are scored each. Without training rows the base is that of N = V = 0 and the score equals it
    for unknown words. Extra columns are not read. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "suffix-tree")
    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    tables = learn_tables(slim.withColumn("train", ~held_out(F.col("doc_id"))), stage, depth)
    n, buckets = tables.tokens, tables.buckets
    null = lambda f: F.lit(None).cast(ddl(pa.schema([f])).split()[1]).alias(f.name)
    stage.drop("counts")
    ready = stage.write(_with_backs(tables), "ready")
    stage.drop("states", "chunks")
    stage.free()
    common, sums = spark.sparkContext.broadcast((tables.hot, tables.hot_values)), None
    for turn in range(TURNS):
        asked = ready.mapInArrow(tidy(_ask(depth, buckets, common, turn)), ddl(_PARCELS))
        offered = tables.values.filter(F.col("bucket") % TURNS == turn).select(*[F.col(f.name) if f.name in ("bucket", "keys", "values") else null(f) for f in _PARCELS])
        got = stage.write(exchange(asked.union(offered), "bucket").mapInArrow(tidy(_answer(depth)), ddl(SUMS)), f"sums-{turn}")
        sums = got if sums is None else sums.union(got)
        stage.free()
    stage.drop("ready", *[f"values-{turn}" for turn in range(TURNS)])
    out = exchange(sums, "chunk").mapInArrow(tidy(_add), SCORES)
    divisor = F.col("n_tokens") * float(np.log10(tables.divisor))
    return out.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") - divisor).alias("base_score"),
        (F.col("tree") - divisor).alias("score"),
    )


# --- a look into the tree of a small corpus -------------------------------------------------------------------------


@dataclass
class Words:
    """Training words: hash, count, symbol (0: a word never seen)."""

    hash: np.ndarray
    count: np.ndarray
    symbol: np.ndarray
    end: int
    tokens: int
    distinct: int
    rare_tokens: int = 0
    rare_distinct: int = 0


@dataclass
class States:
    """The states of one depth: contexts with the share that goes to the suffix, and entries with theirs."""

    context: np.ndarray
    back: np.ndarray
    entry: np.ndarray
    share: np.ndarray


@dataclass
class Tree:
    words: Words
    unigram: np.ndarray
    depths: list[States]


def learn(train: DataFrame, stage: Stage, depth: int = 2) -> tuple[Tree, DataFrame]:
    """The whole tree of a small corpus collected, and its word counts (key, count). Scoring does not collect it.

    Keys are of symbols in BITS each.
    """
    if (depth + 1) * BITS > 64:
        raise ValueError("the keys of a collected tree hold two words of context")
    tables = learn_tables(train.select("doc_id", "text").withColumn("train", F.lit(True)), stage, depth, look=True)
    number_of, rows = {}, []
    for r in tables.vocabulary.collect():
        keys = climbed(r["keys"]).tolist()
        number_of |= dict(zip(keys, decodes(r["numbers"]).tolist()))
        rows += zip(keys, decodes(r["totals"]).tolist())
    rows.sort()
    symbol = {number_of[h]: i for i, (h, _) in enumerate(rows, 1)}
    hashes, counts = np.array([h for h, _ in rows], _U), np.array([c for _, c in rows], np.int64)
    words = Words(hashes, counts, np.arange(1, len(rows) + 1), symbol.get(number_of.get(END), 1), tables.tokens, tables.distinct)
    unigram = np.concatenate([[1.0], counts + 1.0]) if rows else np.ones(2)
    named = [{} for _ in range(depth + 1)]  # keys of grams by depth, as symbols
    for chunk in _read(tables.chunks.toArrow().to_batches()):
        back, there = _before(chunk, depth)
        code = np.array([symbol[n] for n in chunk.number.tolist()], np.int64)
        named[0] |= dict(zip(chunk.hash.tolist(), code.tolist()))
        spelt = code[chunk.index]
        for d, key in enumerate(_keys(chunk, back), 1):
            spelt = spelt | code[back[d - 1]] << BITS * d
            named[d] |= dict(zip(key[there >= d].tolist(), spelt[there >= d].tolist()))
    held = [{} for _ in range(depth)]
    for r in tables.states.filter("kind = 0").collect():
        held[r["depth"] - 1] |= dict(zip(climbed(r["keys"]).tolist(), zip(decodes(r["total"]).tolist(), shared(r["backs"]).tolist())))
    own = [{} for _ in range(depth)]
    for r in tables.counts.collect():
        for d, g in enumerate(_grams(r.asDict())[0]):
            for key, n, context in zip(g.key.tolist(), g.n.tolist(), g.context.tolist()):
                if n >= HELD and context in held[d]:
                    own[d][named[d + 1][key]] = (n - DISCOUNT) / held[d][context][0]
    depths = []
    for d in range(depth):
        contexts = sorted((named[d][c], back) for c, (_, back) in held[d].items())
        entries = sorted(own[d].items())
        depths.append(States(np.array([c for c, _ in contexts], _U), np.array([b for _, b in contexts]), np.array([k for k, _ in entries], _U), np.array([x for _, x in entries])))
    return Tree(words, unigram / unigram.sum(), depths), train.sparkSession.createDataFrame([(h - (1 << 64) if h >> 63 else h, c) for h, c in rows], "key long, count long")
