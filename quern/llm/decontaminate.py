"""Benchmark decontamination by pigeonhole edit matching.

A test item that occurs in a text with at most `budget` edits, cut into budget + 1 pieces, has at least one
piece in it without an edit. All pieces of all items are one Aho-Corasick automaton; each hit names a
window of the text, and Myers' bit-parallel distance decides there. Texts and items are compared in lower
case with each run of white space as one space.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import Stage, tidy

#: Edits that are allowed, as a share of the item's length.
RATE = 0.05
#: Items are matched in blocks of at most so many characters: what a task holds does not grow with the table.
BLOCK_CHARS = 4_000_000
HITS = "doc_id long, item_id long, distance int, start long, stop long"


def plain(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """budget + 1 pieces of nearly equal length, with their places; fewer where there are fewer characters."""
    n = min(budget + 1, len(item))
    cut = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cut, cut[1:])]


class Pattern:
    """Myers' automaton of an item: the least edit distance to any part of a text, and where that part ends."""

    def __init__(self, item: str):
        self.size = len(item)
        self.masks: dict[str, int] = defaultdict(int)
        for i, c in enumerate(item):
            self.masks[c] |= 1 << i

    def best(self, text: str) -> tuple[int, int]:
        """(distance, end); the first end among equals."""
        full, top, masks = (1 << self.size) - 1, 1 << (self.size - 1), self.masks
        up, down, score = full, 0, self.size
        least, end = self.size, 0
        for j, c in enumerate(text):
            eq = masks.get(c, 0)
            diagonal = eq | down
            across = (((eq & up) + up) ^ up) | eq
            more, less = down | (~(across | up) & full), up & across
            if more & top:
                score += 1
            elif less & top:
                score -= 1
            more, less = (more << 1) & full, (less << 1) & full
            up, down = less | (~(diagonal | more) & full), more & diagonal
            if score < least:
                least, end = score, j + 1
        return least, end


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = [(i, x, int(len(x) * rate)) for i, x in items if x]
        self.patterns: dict[int, tuple[Pattern, Pattern]] = {}
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, (_, x, budget) in enumerate(self.items):
            for at, piece in pieces(x, budget):
                places[piece].append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def __call__(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(item, distance, start, stop) of the best match of each item that is within its budget; places in `plain(text)`."""
        if not self.items:
            return
        text = plain(text)
        near: dict[int, list[int]] = defaultdict(list)
        for last, (size, where) in self.automaton.iter(text):
            for n, at in where:
                near[n].append(last + 1 - size - at)  # where the item would start without edits
        for n, starts in near.items():
            key, item, budget = self.items[n]
            if (at := text.find(item)) >= 0:
                yield key, 0, at, at + len(item)
                continue
            starts.sort()
            windows: list[list[int]] = []
            for s in starts:
                if windows and s - windows[-1][1] <= 2 * budget:
                    windows[-1][1] = s
                else:
                    windows.append([s, s])
            if n not in self.patterns:
                self.patterns[n] = Pattern(item), Pattern(item[::-1])
            forward, backward = self.patterns[n]
            found = []
            for a, b in windows:
                a = max(0, a - budget)
                distance, end = forward.best(text[a : b + len(item) + budget])
                if distance <= budget:
                    _, back = backward.best(text[a : a + end][::-1])
                    found.append((distance, a + end - back, a + end))
            if found:
                yield key, *min(found)


_ready: list[tuple[str, Matcher]] = []


def matcher(name: str, items: list[tuple[int, str]], rate: float) -> Matcher:
    """The matcher of a block, made once by a worker for all its tasks; a worker holds one."""
    if not _ready or _ready[0][0] != name:
        _ready[:] = [(name, Matcher(items, rate))]
    return _ready[0][1]


def _matches(name: str, shared, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = matcher(name, shared.value, rate)
        for batch in batches:
            rows = [(k, *hit) for k, t in zip(batch["doc_id"].to_pylist(), batch["text"]) for hit in match(t.as_py())]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["doc_id", "item_id", "distance", "start", "stop"])

    return run


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Distinct items in blocks of bounded size, one at a time on the driver."""
    rows = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("item_id is not null and text is not null").distinct()
    block, size = [], 0
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        x = plain(r["text"])
        if block and size + len(x) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((r["item_id"], x))
        size += len(x)
    if block:
        yield block


def contaminated(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """(doc_id, item_id, distance, start, stop): each pair's best match within floor(rate * length) edits.

    `start` and `stop` are places in the lower-cased text with single spaces. The items are a stated query
    set, taken in blocks of bounded size; every block is held against all rows.

    Nulls: a null or empty text or item matches nothing; a null item_id is left out, a null doc_id is kept.
    Repeated rows give a row each; of an item_id with several texts the best match counts. Extra columns
    are not read. Empty tables give an empty table.
    """
    stage = Stage(docs.sparkSession, "decontaminate")
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    send = docs.sparkSession.sparkContext.broadcast
    found = [stage.write(docs.mapInArrow(tidy(_matches(f"{stage.root}/{i}", send(block), rate)), HITS), f"hits-{i}") for i, block in enumerate(_blocks(items))]
    if not found:
        return docs.sparkSession.createDataFrame([], HITS)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def clean(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of `docs`, all columns as they are, in which no item is found; nulls as in `contaminated`."""
    root = Stage(docs.sparkSession, "decontaminate").root
    for i, block in enumerate(_blocks(items)):

        def run(batches, name=f"{root}/{i}", shared=docs.sparkSession.sparkContext.broadcast(block)):
            match = matcher(name, shared.value, rate)
            for batch in batches:
                yield batch.filter(pa.array([next(match(t.as_py()), None) is None for t in batch["text"]], pa.bool_()))

        docs = docs.mapInArrow(tidy(run), docs.schema)
    return docs
