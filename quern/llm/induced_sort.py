"""Suffix sorting by induction, in queues that go to disk.

Suffixes whose next character is smaller (L) or larger (S) follow from the order of others: sorted S*
suffixes (an S after an L) give all L suffixes in one ascending sweep, those give all S suffixes in a
descending one. The queue of a sweep has a first-in-first-out list for each character: its priority. An
entry is a suffix and the length of the prefix that it has in common with the entry before it; what a
sweep induces has one character more in common than the least of what lies between its sources. Entries
move in whole arrays; lists over the memory limit go to an unlinked scratch file of the task, which ends
with the task. A text over the limit is read through a memory map of such a file.

Texts are several pieces: a prefix in common never runs past the end of a piece.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Bytes of queue entries, and of text, that are held in memory.
MEMORY = 256 << 20
CAP = 254  # of a common prefix


class Queue:
    """A priority queue of arrays: a list for each symbol, in order of arrival, on disk beyond the limit."""

    def __init__(self, symbols: int, memory: int):
        self.lists: list[list] = [[] for _ in range(symbols)]
        self.memory, self.held, self.file = memory, 0, None

    def push(self, symbol: int, suffix: np.ndarray, common: np.ndarray) -> None:
        self.held += suffix.nbytes + common.nbytes
        if self.held > self.memory:
            self.spill()
        self.lists[symbol].append((suffix, common))

    def spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for entries in self.lists:
            for i, e in enumerate(entries):
                if e[0] is not None and not isinstance(e[0], int):
                    entries[i] = (self.file.tell(), len(e[0]), e[0].dtype)
                    self.file.write(e[0].tobytes())
                    self.file.write(e[1].tobytes())
        self.held = 0

    def entry(self, e: tuple) -> tuple[np.ndarray, np.ndarray]:
        if not isinstance(e[0], int):
            return e
        at, n, kind = e
        self.file.seek(at)
        return np.frombuffer(self.file.read(n * kind.itemsize), kind), np.frombuffer(self.file.read(n), np.uint8)

    def waves(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The entries of a symbol in order, also those that arrive meanwhile; they stay in the queue."""
        i = 0
        while i < len(self.lists[symbol]):
            last = len(self.lists[symbol])
            parts = [self.entry(e) for e in self.lists[symbol][i:last]]
            i = last
            yield (parts[0] if len(parts) == 1 else tuple(np.concatenate(x) for x in zip(*parts)))

    def take(self, symbol: int) -> tuple[np.ndarray, np.ndarray] | None:
        """All entries of a symbol, which leave."""
        entries, self.lists[symbol] = self.lists[symbol], []
        if not entries:
            return None
        parts = [self.entry(e) for e in entries]
        self.held -= sum(p[0].nbytes + p[1].nbytes for p, e in zip(parts, entries) if not isinstance(e[0], int))
        return parts[0] if len(parts) == 1 else tuple(np.concatenate(x) for x in zip(*parts))


class _Minimum:
    """Minima of ranges of a byte array, by doubling."""

    def __init__(self, x: np.ndarray):
        self.levels, step = [x], 1
        while 2 * step <= len(x):
            low = self.levels[-1]
            self.levels.append(np.minimum(low[:-step], low[step:]))
            step *= 2

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """min x[lo:hi], all hi > lo."""
        size = hi - lo
        level = np.frexp(size.astype(np.float64))[1] - 1
        out = np.empty(len(lo), np.uint8)
        for k in np.unique(level).tolist():
            own = level == k
            out[own] = np.minimum(self.levels[k][lo[own]], self.levels[k][hi[own] - (1 << k)])
        return out


class _Sweep:
    """The state of one sweep: what it has induced, and the least prefix since each list's last entry."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, queue: Queue, symbols: int):
        self.text, self.wanted, self.queue = text, wanted, queue
        self.since = np.zeros(symbols, np.uint8)
        self.begun = np.zeros(symbols, bool)

    def feed(self, suffix: np.ndarray, common: np.ndarray) -> None:
        """Sources in order, with what each has in common with the one before it."""
        if not len(suffix):
            return
        before = suffix - 1
        ok = np.flatnonzero((before >= 0) & self.wanted[before])
        if len(ok):
            to = self.text[before[ok]].astype(np.uint16)
            order = np.argsort(to, kind="stable")
            to, ok = to[order], ok[order]
            new = np.concatenate([[True], to[1:] != to[:-1]])
            lo = np.where(new, 0, np.concatenate([[0], ok[:-1] + 1]))
            least = _Minimum(common).of(lo, ok + 1)
            first = np.flatnonzero(new)
            names = to[first]
            least[first] = np.where(self.begun[names], np.minimum(least[first], self.since[names]), 0)
            share = np.minimum(least, CAP - 1) + np.uint8(1)
            share[first] = np.where(self.begun[names], share[first], 0)
            self.begun[names] = True
            for symbol, a, b in zip(names.tolist(), first.tolist(), [*first[1:].tolist(), len(to)]):
                if symbol:
                    self.queue.push(symbol, before[ok[a:b]], share[a:b])
            # what follows the last push of each list
            last = np.concatenate([ok[first[1:] - 1], ok[-1:]])
            rest = np.minimum.accumulate(common[::-1])[::-1]
            self.since = np.minimum(self.since, rest[0])
            self.since[names] = np.where(last + 1 < len(common), rest[np.minimum(last + 1, len(common) - 1)], 255)
        else:
            self.since = np.minimum(self.since, common.min())


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """The common prefix of pairs of suffixes, to `cap`, by comparing characters; ends of pieces are never equal."""
    out = np.zeros(len(a), np.uint8)
    live = np.arange(len(a))
    for k in range(cap):
        x, y = text[np.minimum(a[live] + k, len(text) - 1)], text[np.minimum(b[live] + k, len(text) - 1)]
        live = live[(x == y) & (x != 0)]
        if not len(live):
            break
        out[live] += 1
    return out


def _split(name: np.ndarray, of: np.ndarray, key: np.ndarray) -> None:
    """Splits groups by key: `name` is the place of a group's first member in the order, `of` all members of the groups."""
    order = np.lexsort((key, name[of])) if key.itemsize > 4 else np.argsort(name[of].astype(np.int64) << 32 | key, kind="stable")
    of, key = of[order], key[order]
    own = name[of]
    place = np.arange(len(of))
    new = np.concatenate([[True], own[1:] != own[:-1]])
    part = new.copy()
    part[1:] |= key[1:] != key[:-1]
    start = np.maximum.accumulate(np.where(new, place, 0))
    name[of] = own + np.maximum.accumulate(np.where(part, place, 0)) - start


def _sorted_stars(text: np.ndarray, stars: np.ndarray, depth: int) -> np.ndarray:
    """S* suffixes in order of their first `depth` characters.

    The recursion: a star is named by the order of its substring to the next one, and pairs of names are
    named again, doubling what a name spans, until names tell all stars apart or span `depth`. A round
    touches only stars whose name is not their own.
    """
    n = len(stars)
    if not n:
        return stars
    size = np.minimum(np.diff(np.append(stars, len(text))), CAP)
    name = np.zeros(n, np.int64)
    of = np.arange(n)
    for at in range(0, depth, 7):
        key = np.zeros(len(of), np.int64)
        for k in range(at, at + 7):
            c = text[np.minimum(stars[of] + k, len(text) - 1)].astype(np.int64)
            key = key * 258 + np.where(k <= size[of], c, 257)  # of two, one a prefix of the other, the shorter is larger
        _split(name, of, key)
        longer = np.zeros(n, bool)
        longer[name[size >= at + 7]] = True
        of = np.flatnonzero(longer[name] & (np.bincount(name, minlength=n) > 1)[name])
        if not len(of):
            break
    last = text[stars] == 0
    piece = np.cumsum(last) - last
    span, hop = size.copy(), 1
    while len(of := np.flatnonzero((np.bincount(name, minlength=n) > 1)[name] & ~last)):
        open_ = np.zeros(n, bool)
        open_[name[of[span[of] < depth]]] = True
        of = of[open_[name[of]]]
        if not len(of):
            break
        after = np.minimum(of + hop, n - 1)
        inside = (of + hop < n) & (piece[after] == piece[of])
        _split(name, of, np.where(inside, name[after] + 1, 0).astype(np.int32 if n < 1 << 31 else np.int64))
        reach = np.minimum(np.arange(n) + hop, n - 1)
        span = np.where((np.arange(n) + hop < n) & (piece[reach] == piece), np.minimum(span + span[reach], CAP), CAP)
        hop *= 2
    return stars[np.argsort(name, kind="stable")]


def mapped(text: np.ndarray, memory: int) -> np.ndarray:
    """The text itself, or a memory map of it where it is over the limit."""
    if text.nbytes <= memory:
        return text
    file = tempfile.TemporaryFile()
    text.tofile(file)
    file.flush()
    return np.memmap(file, text.dtype, "r")


def suffix_order(data: np.ndarray, ends: np.ndarray, depth: int, memory: int = MEMORY) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Suffixes of pieces of `data` (bytes; `ends` of the pieces) in descending order, as arrays by first character.

    Yields (places in `data`, common): `common` is the length of the prefix that a suffix and the one before
    it in the array have in common, exact up to `depth` (at most CAP - 1). The order is by the first `depth`
    characters; beyond them it is any.
    """
    if not len(data):
        return
    n, m = len(data), len(ends)
    kind = np.int32 if n + m < 1 << 31 else np.int64
    place = np.repeat(np.arange(m, dtype=kind), np.diff(ends, prepend=0))
    place += np.arange(n, dtype=kind)  # of a byte in the text with ends
    text = np.zeros(n + m, np.uint16)
    text[place] = data
    text[place] += 1
    del place
    # S: smaller than what follows; of a run, as its last one
    up = np.empty(len(text), bool)
    up[-1] = True
    up[:-1] = text[:-1] < text[1:]
    tie = np.flatnonzero(text[:-1] == text[1:])
    if len(tie):
        fixed = np.ones(len(text), bool)
        fixed[tie] = False
        known = np.flatnonzero(fixed)
        up[tie] = up[known[np.searchsorted(known, tie)]]
    up[text == 0] = True
    star = np.flatnonzero(up[1:] & ~up[:-1]) + 1
    before = np.cumsum(text == 0, dtype=kind)  # ends of pieces before a place
    text = mapped(text, memory)
    star = _sorted_stars(text, star, depth).astype(kind)
    first = text[star].astype(np.int64)
    alike = np.concatenate([[0], _common(text, star[:-1], star[1:], depth)]).astype(np.uint8)
    seeds = np.searchsorted(first, np.arange(258))

    down = ~up
    queue = Queue(257, memory)
    sweep = _Sweep(text, down, queue, 257)
    for c in range(257):
        last, opened = None, True
        for suffix, common in queue.waves(c):
            common = common.copy()
            if opened:
                common[0], opened = 0, False
            sweep.feed(suffix, common)
            last = suffix[-1:]
        own, common = star[seeds[c] : seeds[c + 1]], alike[seeds[c] : seeds[c + 1]].copy()
        if len(own):
            common[0] = 0 if last is None else _common(text, last, own[:1], depth)[0]
            sweep.feed(own, common)

    back = Queue(257, memory)
    sweep = _Sweep(text, up, back, 257)
    for c in range(256, 0, -1):
        out, opened = [], True
        for suffix, common in back.waves(c):
            common = common.copy()
            if opened:
                common[0], opened = 0, False
            sweep.feed(suffix, common)
            out.append((suffix, common))
        back.take(c)
        if (below := queue.take(c)) is not None:
            suffix, common = below[0][::-1], np.concatenate([[0], below[1][:0:-1]]).astype(np.uint8)
            if out:
                common[0] = _common(text, out[-1][0][-1:], suffix[:1], depth)[0]
            sweep.feed(suffix, common)
            out.append((suffix, common))
        if out:
            suffix, common = (np.concatenate(x) for x in zip(*out))
            yield suffix - before[suffix], common
