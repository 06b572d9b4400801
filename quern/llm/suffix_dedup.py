"""Removal of passages that an earlier document has, by sharded suffix arrays.

A string of `length` bytes is in the shard that its anchor names: the least hash among the short strings
in it, so equal strings meet wherever they stand. Anchors that one document alone has are dropped first.
What is left of a text are pieces: runs of strings with one anchor. Equal pieces are one, of the least
document that has it; the suffixes of a shard's pieces are sorted by `induced_sort`, where strings in
common stand side by side, and each string gets the least document of its group. All sizes of a task
follow its share of the input: shards are taken a few MB at a time, and one anchor with more than that
is sorted in queues on disk.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .induced_sort import CAP, suffix_order
from .stage import Stage, parts, tidy
from .tally import mix, pack, unpack

_U = np.uint64
ANCHOR = 20  # bytes of the strings whose hashes are compared
ANCHOR_BITS = 48
#: Bytes of text that are worked on at once, pairs and bytes of pieces that are sent at once, bytes of pieces that are sorted at once.
CHUNK, PAIRS, PIECES, SORTED = 1 << 20, 2_000_000, 8 << 20, 4 << 20
NONE = (1 << 63) - 1  # a null doc_id: after all others
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, _U)
    out[0] = 1
    return np.cumprod(out, dtype=_U)


def _rolled(data: np.ndarray, size: int) -> np.ndarray:
    """A polynomial hash of each string of `size` bytes, by doubling."""
    power = lambda n: _U(pow(_BASE, n, 1 << 64))
    now, width = data.astype(_U) + _U(1), 1
    out, have = None, 0
    while size:
        if size & 1:
            out = now if out is None else out[: len(out) - width] * power(width) + now[have:]
            have += width
        size >>= 1
        if size:
            now = now[:-width] * power(width) + now[width:]
            width *= 2
    return out


def runs(data: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings with one anchor in documents of `sizes` bytes: first string's place, number of strings, anchor, document."""
    none = np.empty(0, np.int64)
    if len(data) < length:
        return none, none, np.empty(0, _U), none
    k = min(ANCHOR, length)
    doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    h = mix(_rolled(data, k)) >> _U(64 - ANCHOR_BITS)
    wide, low, width = length - k + 1, h, 1
    while 2 * width <= wide:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < wide:
        low = np.minimum(low[: len(low) - (wide - width)], low[wide - width :])
    at = np.flatnonzero(doc[: len(low)] == doc[length - 1 : length - 1 + len(low)])
    if not len(at):
        return none, none, np.empty(0, _U), none
    low = low[at]
    first = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (at[1:] != at[:-1] + 1)]))
    return at[first], np.diff(np.append(first, len(at))), low[first], doc[at[first]].astype(np.int64)


def _slot(x: np.ndarray, buckets: int) -> np.ndarray:
    return (x ^ (x >> 15) ^ (x >> 31)) % buckets


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    """Rows (as tuples without the text) and texts, about a MB at a time."""
    rows, texts, size = [], [], 0
    for batch in batches:
        keys = [batch[c].to_pylist() for c in batch.schema.names if c != "text"]
        for *row, t in zip(*keys, batch["text"]):
            rows.append(row)
            texts.append((t.as_py() or "").encode())
            size += len(texts[-1])
            if size >= CHUNK:
                yield rows, texts
                rows, texts, size = [], [], 0
    if rows:
        yield rows, texts


def _buckets(of: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of a sorted array."""
    names, first = np.unique(of, return_index=True)
    yield from zip(names.tolist(), first.tolist(), [*first[1:].tolist(), len(of)])


def _rows(columns: dict[str, pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), columns.values())], names=list(columns))


_PAIR = {"bucket": pa.int32(), "docs": pa.binary(), "keys": pa.binary()}
PAIR = "bucket int, docs binary, keys binary"


def _anchors(length: int, buckets: int):
    """Distinct (anchor, document) pairs, packed by anchor."""

    def run(batches):
        keys, docs, size = [], [], 0

        def send():
            key, doc = np.concatenate(keys), np.concatenate(docs)
            order = np.argsort(((mix(key) % _U(buckets)) << _U(ANCHOR_BITS)) | key)
            key, doc = key[order], doc[order]
            for b, lo, hi in _buckets((mix(key) % _U(buckets)).astype(np.int32)):
                yield _rows(_PAIR, [(b, pack(doc[lo:hi].astype(np.int64)), pack(np.diff(key[lo:hi], prepend=_U(0))))])

        for rows, texts in _chunks(batches):
            _, _, key, of = runs(np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts]), length)
            ids = np.array([r[0] for r in rows], np.int64)
            for lo in range(0, len(texts), 1 << 15):
                own = (of >= lo) & (of < lo + (1 << 15))
                pair = np.unique(((of[own] - lo).astype(_U) << _U(ANCHOR_BITS)) | key[own])
                keys.append(pair & _U((1 << ANCHOR_BITS) - 1))
                docs.append(ids[(pair >> _U(ANCHOR_BITS)).astype(np.int64) + lo])
                size += len(pair)
            if size >= PAIRS:
                yield from send()
                keys, docs, size = [], [], 0
        if size:
            yield from send()

    return run


def _shared(buckets: int):
    """Of pairs packed by anchor those whose anchor several documents have, packed by document."""

    def run(batches):
        keys, docs = [], []
        for batch in batches:
            keys += [np.cumsum(unpack(x, _U), dtype=_U) for x in batch["keys"].to_pylist()]
            docs += [unpack(x, np.int64) for x in batch["docs"].to_pylist()]
        if not keys:
            return
        key, doc = np.concatenate(keys), np.concatenate(docs)
        order = np.argsort(key)
        key, doc = key[order], doc[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
        held = np.repeat(several, np.diff(np.append(first, len(key))))
        key, doc = key[held], doc[held]
        of = _slot(doc, buckets)
        order = np.lexsort((doc, of))
        key, doc, of = key[order], doc[order], of[order]
        for b, lo, hi in _buckets(of):
            yield _rows(_PAIR, [(b, pack(np.diff(doc[lo:hi], prepend=0)), pack(key[lo:hi]))])

    return run


_PIECE = {"bucket": pa.int32(), "keys": pa.binary(), "docs": pa.binary(), "tags": pa.binary(), "starts": pa.binary(), "counts": pa.binary(), "names": pa.binary(), "data": pa.binary()}
PIECE = "bucket int, keys binary, docs binary, tags binary, starts binary, counts binary, names binary, data binary"


def _take(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of slices, one after the other."""
    ends = np.cumsum(size)
    kind = np.int32 if len(data) < 1 << 31 and len(ends) and ends[-1] < 1 << 31 else np.int64
    index = np.repeat((start - (ends - size)).astype(kind), size)
    index += np.arange(len(index), dtype=kind)
    return data[index]


#: Texts of one bucket, or rows packed by document that go before them.
BESIDE = pa.schema([("bucket", pa.int32()), ("side", pa.int32()), ("docs", pa.binary()), ("keys", pa.binary()), ("sizes", pa.binary()), ("data", pa.binary())])
#: Bytes of texts that a task holds before it sends them.
TEXTS = 8 << 20


def _dealt(buckets: int):
    """Texts packed by document's bucket and compressed; `keys` of rows with a null id are in `docs`' place after NONE."""

    def run(batches):
        held, size = {}, 0

        def send():
            for b, rows in sorted(held.items()):
                ids, texts = zip(*rows)
                sizes = np.array([len(t) for t in texts], np.int64)
                yield _rows(_BESIDE, [(b, 1, pack(np.array([NONE if i is None else i for i in ids], np.int64)), pack(np.array([i is None for i in ids], np.uint8)), pack(sizes), zstandard.ZstdCompressor(level=1).compress(b"".join(texts)))])

        for batch in batches:
            of = _slot(pc.fill_null(batch["doc_id"], NONE).to_numpy(zero_copy_only=False), buckets)
            for b, i, t in zip(of.tolist(), batch["doc_id"].to_pylist(), batch["text"]):
                text = (t.as_py() or "").encode()
                held.setdefault(b, []).append((i, text))
                size += len(text) + 64
                if size >= TEXTS:
                    yield from send()
                    held, size = {}, 0
        yield from send()

    return run


_BESIDE = {f.name: f.type for f in BESIDE}


def _split_side(batches: Iterator[pa.RecordBatch]) -> tuple[list[dict], Iterator[tuple[list, list[bytes]]]]:
    """The packed rows that stand before the texts of a partition; (key, doc_id) and texts, about a MB at a time."""
    packed: list[dict] = []
    first: list[dict] = []
    batches = iter(batches)
    for batch in batches:
        rows = batch.to_pylist()
        packed += [r for r in rows if r["side"] == 0]
        first = [r for r in rows if r["side"] == 1]
        if first:
            break

    def rest():
        rows, texts, size = [], [], 0
        for r in itertools.chain(first, (r for b in batches for r in b.to_pylist())):
            data, at = zstandard.ZstdDecompressor().decompress(r["data"]), 0
            for key, null, n in zip(unpack(r["docs"], np.int64).tolist(), unpack(r["keys"], np.uint8).tolist(), unpack(r["sizes"], np.int64).tolist()):
                rows.append((key, None if null else key))
                texts.append(data[at : at + n])
                at, size = at + n, size + n
                if size >= CHUNK:
                    yield rows, texts
                    rows, texts, size = [], [], 0
        if rows:
            yield rows, texts

    return packed, rest()


def _pieces(length: int, buckets: int):
    """Pieces of the texts of a partition whose anchors are shared, packed by anchor."""

    def run(batches):
        packed, texts_of = _split_side(iter(batches))
        doc = [np.cumsum(unpack(r["docs"], np.int64)) for r in packed]
        name = lambda d, k: mix(mix(d.view(_U)) ^ k)
        known = np.sort(np.concatenate([np.empty(0, _U), *(name(d, unpack(r["keys"], _U)) for d, r in zip(doc, packed))]))
        if not len(known):
            return
        power, back = _powers(_BASE, 2 * CHUNK), _powers(_INVERSE, 2 * CHUNK)
        held, size = [], 0

        def send():
            key, doc, tag, start, count, named = (np.concatenate(x) for x in list(zip(*held))[:6])
            data = np.concatenate([h[6] for h in held])
            ends = np.cumsum(count + length - 1)
            of = (mix(key) % _U(buckets)).astype(np.int32)
            order = np.argsort(of, kind="stable")
            key, doc, tag, start, count, named, of, ends = key[order], doc[order], tag[order], start[order], count[order], named[order], of[order], ends[order]
            for b, lo, hi in _buckets(of):
                n = count[lo:hi] + length - 1
                body = zstandard.ZstdCompressor(level=1).compress(_take(data, ends[lo:hi] - n, n).tobytes())
                yield _rows(_PIECE, [(b, pack(key[lo:hi]), pack(doc[lo:hi]), pack(tag[lo:hi]), pack(start[lo:hi].astype(np.uint32)), pack(count[lo:hi].astype(np.uint32)), pack(named[lo:hi]), body)])

        for rows, texts in texts_of:
            data, sizes = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
            at, count, key, of = runs(data, sizes, length)
            ids = np.array([r[0] for r in rows], np.int64)[of]
            place = np.minimum(np.searchsorted(known, name(ids, key)), len(known) - 1)
            flagged = known[place] == name(ids, key)
            at, count, key, of, ids = at[flagged], count[flagged], key[flagged], of[flagged], ids[flagged]
            if not len(at):
                continue
            if len(data) >= len(power):
                power, back = _powers(_BASE, len(data)), _powers(_INVERSE, len(data))
            whole = np.concatenate([np.zeros(1, _U), np.cumsum((data.astype(_U) + _U(1)) * power[: len(data)], dtype=_U)])
            n = count + length - 1
            named = mix((whole[at + n] - whole[at]) * back[at] + n.astype(_U))
            tags = np.array([zlib.crc32(t) for t in texts], np.uint32)[of]
            held.append((key, ids, tags, at - (np.cumsum(sizes) - sizes)[of], count, named, _take(data, at, n)))
            size += len(held[-1][6])
            if size >= PIECES:
                yield from send()
                held, size = [], 0
        if size:
            yield from send()

    return run


def least_documents(data: np.ndarray, ends: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """For each place in the pieces `data` the least of `doc` among the pieces with the same `length` bytes there.

    Where fewer bytes are left in the piece, that piece's own.
    """
    piece = np.repeat(np.arange(len(ends), dtype=np.int32), np.diff(ends, prepend=0))
    out = doc[piece]
    for suffix, common in suffix_order(data, ends, length):
        first = np.flatnonzero(np.concatenate([[True], common[1:] < length]))
        size = np.diff(np.append(first, len(suffix)))
        least = np.minimum.reduceat(out[suffix], first)
        grouped = np.repeat(size > 1, size)
        out[suffix[grouped]] = np.repeat(least, size)[grouped]
    return out


def _tell_apart(data: np.ndarray, at: np.ndarray, n: np.ndarray, key: np.ndarray, named: np.ndarray) -> None:
    """Gives pieces whose names are equal but whose bytes are not names of their own."""
    live = np.arange(len(key))
    while len(live):
        order = live[np.lexsort((named[live], key[live]))]
        new = np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (named[order][1:] != named[order][:-1])])
        head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        other, head = order[~new], head[~new]
        odd = n[other] != n[head]
        same = np.flatnonzero(~odd)
        for lo in range(0, len(same), 1 << 14):
            a, b = other[same[lo : lo + (1 << 14)]], head[same[lo : lo + (1 << 14)]]
            differ = _take(data, at[a], n[a]) != _take(data, at[b], n[b])
            odd[same[lo : lo + (1 << 14)]] = np.logical_or.reduceat(differ, np.cumsum(n[a]) - n[a])
        live = other[odd]  # against each other, under a next name
        named[live] = mix(named[live] + _U(1))


def _spans(length: int, buckets: int):
    """Of pieces packed by anchor the strings that a smaller document has, as spans packed by document."""

    def run(batches):
        key, doc, tag, start, count, named, body = ([] for _ in range(7))
        for batch in batches:
            for r in batch.to_pylist():
                key.append(unpack(r["keys"], _U))
                doc.append(unpack(r["docs"], np.int64))
                tag.append(unpack(r["tags"], np.uint32))
                start.append(unpack(r["starts"], np.uint32).astype(np.int64))
                count.append(unpack(r["counts"], np.uint32).astype(np.int64))
                named.append(unpack(r["names"], _U))
                body.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(r["data"]), np.uint8))
        if not key:
            return
        key, doc, tag, start, count, named = (np.concatenate(x) for x in (key, doc, tag, start, count, named))
        data = np.concatenate(body)
        body.clear()
        n = count + length - 1
        at = np.cumsum(n) - n
        _tell_apart(data, at, n, key, named)
        order = np.lexsort((doc, named, key))
        key, doc, tag, start, count, named, n, at = (x[order] for x in (key, doc, tag, start, count, named, n, at))
        # equal pieces are one piece, of its first document
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (named[1:] != named[:-1])]))
        of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
        group = np.flatnonzero(np.concatenate([[True], key[first][1:] != key[first][:-1]]))
        size = np.diff(np.append(group, len(first)))
        alone = np.repeat(size == 1, size)
        out_doc, out_tag, out_from, out_to = [], [], [], []
        later = alone[of] & (doc > doc[first][of])
        out_doc.append(doc[later])
        out_tag.append(tag[later])
        out_from.append(start[later])
        out_to.append((start + n)[later])

        # pieces of anchors with several, a few MB of whole anchors at a time
        pieces = np.flatnonzero(~alone)
        bytes_ = np.cumsum(n[first[pieces]])
        cut = np.flatnonzero(np.concatenate([[True], key[first[pieces]][1:] != key[first[pieces]][:-1]])) if len(pieces) else pieces
        part = bytes_[cut] // SORTED
        edges = [*cut[np.concatenate([[True], part[1:] != part[:-1]])].tolist(), len(pieces)] if len(cut) else []
        where = np.full(len(first), -1, np.int64)
        for lo, hi in zip(edges, edges[1:]):
            own = first[pieces[lo:hi]]
            held, ends = _take(data, at[own], n[own]), np.cumsum(n[own])
            least = least_documents(held, ends, doc[own], length)
            where[:] = -1
            where[pieces[lo:hi]] = ends - n[own]
            a, b = np.searchsorted(of, [pieces[lo], pieces[hi - 1] + 1])
            rows = np.arange(a, b)[where[of[a:b]] >= 0]
            rows = rows[doc[rows] > _least_of(least, ends, n[own])[np.searchsorted(pieces[lo:hi], of[rows])]]
            for at_once in range(0, len(rows), 1 << 16):
                r = rows[at_once : at_once + (1 << 16)]
                total = np.cumsum(count[r])
                begin = total - count[r]
                step = np.arange(total[-1]) - np.repeat(begin, count[r])
                earlier = least[np.repeat(where[of[r]], count[r]) + step] < np.repeat(doc[r], count[r])
                edge = np.diff(np.concatenate([[0], earlier.astype(np.int8), [0]]))
                edge_at = np.zeros(total[-1] + 1, bool)
                edge_at[begin] = True  # spans end with their row
                opens = np.flatnonzero(earlier & ((edge[:-1] == 1) | edge_at[:-1]))
                edge_at[-1] = True
                closes = np.flatnonzero(earlier & ((edge[1:] == -1) | edge_at[1:]))
                row = r[np.searchsorted(total, opens, "right")]
                out_doc.append(doc[row])
                out_tag.append(tag[row])
                out_from.append(start[row] + step[opens])
                out_to.append(start[row] + step[closes] + length)
        doc, tag, lo_, hi_ = (np.concatenate(x) for x in (out_doc, out_tag, out_from, out_to))
        slot = _slot(doc, buckets)
        order = np.lexsort((lo_, doc, slot))
        doc, tag, lo_, hi_, slot = (x[order] for x in (doc, tag, lo_, hi_, slot))
        for b, a, z in _buckets(slot):
            body = np.stack([tag[a:z].astype(np.uint32), lo_[a:z].astype(np.uint32), (hi_ - lo_)[a:z].astype(np.uint32)]).ravel()
            yield _rows(_PAIR, [(b, pack(np.diff(doc[a:z], prepend=0)), pack(body))])

    return run


def _least_of(least: np.ndarray, ends: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The least of each piece's values."""
    return np.minimum.reduceat(least, ends - n) if len(ends) else least


KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _cut(with_text: bool):
    def run(batches):
        packed, texts_of = _split_side(iter(batches))
        body = [unpack(r["keys"], np.uint32).reshape(3, -1) for r in packed]
        doc = np.concatenate([np.empty(0, np.int64), *(np.cumsum(unpack(r["docs"], np.int64)) for r in packed)])
        tag, lo, size = np.concatenate([np.empty((3, 0), np.uint32), *body], axis=1).astype(np.int64)
        order = np.lexsort((lo, tag, doc))
        doc, tag, lo, hi = doc[order], tag[order], lo[order], (lo + size)[order]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        for rows, texts in texts_of:
            out = []
            for (key, doc_id), t in zip(rows, texts):
                a, b = np.searchsorted(doc, [key, key + 1]) if key < NONE else (np.searchsorted(doc, key), len(doc))
                kept, removed, spans = t, 0, 0
                if b > a:
                    own = zlib.crc32(t)
                    a, b = a + np.searchsorted(tag[a:b], own), a + np.searchsorted(tag[a:b], own, "right")
                if b > a:
                    reach = np.maximum.accumulate(hi[a:b])
                    new = np.flatnonzero(np.concatenate([[True], lo[a + 1 : b] > reach[:-1]]))
                    begins, ends = lo[a:b][new], np.append(reach[new[1:] - 1], reach[-1])
                    removed, spans = int((ends - begins).sum()), len(new)
                    kept = b"".join(t[x:y] for x, y in zip([0, *ends.tolist()], [*begins.tolist(), len(t)]))
                out.append((doc_id, len(t), removed, spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[c.split()[0] for c in KEPT.split(", ")])

    return run


def suffix_dedup(df: DataFrame, length: int = 50, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """One row per row of `df`: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes if `with_text`, else null).

    Texts are UTF-8 bytes. Each byte that a string of `length` bytes covers which also starts in a document
    with a smaller doc_id is removed; strings are judged on the input, and never cross documents.

    `length` is at most 253: longer prefixes in common are not told apart.

    Nulls: a null text is empty; a null key is larger than all others, so such rows lose what others have (it
    shares its place with the largest id, 2**63 - 1).
    Rows of one key take nothing from each other. Empty and short texts stay. Repeated rows have equal
    results. Extra columns are not read. An empty table gives an empty table.
    """
    if not 1 <= length < CAP:
        raise ValueError(f"length is from 1 to {CAP - 1}")
    spark = df.sparkSession
    n = parts(spark)
    buckets = 4 * n + 1
    stage = Stage(spark, "suffix-dedup")
    name = F.coalesce(df[key].cast("long"), F.lit(NONE))
    docs = df.select(name.alias("key"), df[key].cast("long").alias("doc_id"), df[text].cast("string").alias("text"))

    def beside(packed: DataFrame) -> DataFrame:
        """Texts dealt by document, the packed rows of each partition's documents before them."""
        left = packed.select("bucket", F.lit(0).alias("side"), "docs", "keys", *[F.lit(None).cast("binary").alias(c) for c in ("sizes", "data")])
        right = docs.select("doc_id", "text").mapInArrow(tidy(_dealt(buckets)), "bucket int, side int, docs binary, keys binary, sizes binary, data binary")
        return left.unionByName(right).repartition(n, "bucket").sortWithinPartitions("side")

    pairs = docs.select("key", "text").mapInArrow(tidy(_anchors(length, buckets)), PAIR)
    shared = stage.write(pairs.repartition(n, "bucket").mapInArrow(tidy(_shared(buckets)), PAIR), "shared")
    del pairs
    stage.free()
    pieces = beside(shared).mapInArrow(tidy(_pieces(length, buckets)), PIECE)
    spans = stage.write(pieces.repartition(n, "bucket").mapInArrow(tidy(_spans(length, buckets)), PAIR), "spans")
    del pieces
    stage.drop("shared")
    stage.free()
    return beside(spans).mapInArrow(tidy(_cut(with_text)), KEPT)
