"""Exact counts of 64-bit keys, far more than memory holds.

Each task counts its keys in sorted arrays and sends them, packed, to buckets; a bucket's counts are added
by one task. A key in a third of all rows is one entry a task. Buckets hold a share of the distinct keys,
so their size is the input's over the number of shuffle partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .stage import parts, tidy

_U = np.uint64
#: Keys that a task holds before it counts and sends them.
HELD = 3_000_000


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def pack(x: np.ndarray) -> bytes:
    """Unsigned integers, byte plane by byte plane, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def unpack(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(raw.T).view(kind).ravel()


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


def _send(keys: list[np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    of = (mix(key) % _U(buckets)).astype(np.int32)
    order = np.argsort(of, kind="stable")
    key, count, of = key[order], count[order].astype(np.uint64), of[order]
    names, at = np.unique(of, return_index=True)
    rows = []
    for b, lo, hi in zip(names.tolist(), at, [*at[1:], len(of)]):
        rows.append((b, pack(np.diff(key[lo:hi], prepend=_U(0))), pack(count[lo:hi])))
        if len(rows) == 64:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "keys", "counts"])
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "keys", "counts"])


def tally(df: DataFrame, keys_of: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], finish: Callable[[np.ndarray, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """Counts the uint64 keys that `keys_of` yields from the rows; `finish` makes rows of a bucket's sorted keys and counts."""
    n = parts(df.sparkSession)
    buckets = 4 * n

    def count(batches):
        held, size = [], 0
        for keys in keys_of(batches):
            held.append(keys)
            size += len(keys)
            if size >= HELD:
                yield from _send(held, buckets)
                held, size = [], 0
        if size:
            yield from _send(held, buckets)

    def add(batches):
        keys, counts = [], []
        for batch in batches:
            keys += [np.cumsum(unpack(x, np.uint64), dtype=np.uint64) for x in batch["keys"].to_pylist()]
            counts += [unpack(x, np.uint64) for x in batch["counts"].to_pylist()]
        if keys:
            yield finish(*summed(np.concatenate(keys), np.concatenate(counts)))

    return df.mapInArrow(tidy(count), "bucket int, keys binary, counts binary").repartition(n, "bucket").mapInArrow(tidy(add), schema)
