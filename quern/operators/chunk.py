"""Sections to chunks: whole sections where they fit, else packed units under a token budget.

`chunk_sections` takes any kind of section and any token counter, document by document in Arrow batches.
`pack_prose` is the packing of prose alone as a fold in the JVM, for the estimated counter.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import CHUNK_NAMESPACE, TABLE_RULE, estimate_tokens
from quern.operators.staging import bounded

NAMESPACE = uuid.UUID(CHUNK_NAMESPACE)
SAFETY = 8
_SENTENCE = re.compile(r"(?<=[.!?…])\s+(?=[«\"'(\[A-ZÀ-ÖØ-Þ0-9])")
_RULE = re.compile(TABLE_RULE)
Counter = Callable[[str], int]


@dataclass(frozen=True)
class ChunkConfig:
    target: int = 400
    max: int = 700
    min: int = 60
    overlap: float = 0.15

    def __post_init__(self):
        if not 0 <= self.overlap < 0.5:
            raise ValueError("overlap is from 0 to under 0.5")
        if self.target > self.max:
            raise ValueError("target is at most max")

    @property
    def overlap_tokens(self) -> int:
        return int(self.target * self.overlap)


def estimate(text: str) -> int:
    return max(1, round(len(text) / 3.0)) if text else 0


@dataclass(frozen=True)
class Section:
    text: str
    heading_path: tuple[str, ...] = ()
    kind: str = "prose"
    page_start: int | None = None
    page_end: int | None = None
    row: int | None = None
    sheet: str | None = None
    rec_id: str | None = None

    def __post_init__(self):
        if (self.page_start is None) != (self.page_end is None):
            raise ValueError("pages are given both or not at all")
        if self.page_start is not None and not 1 <= self.page_start <= self.page_end:
            raise ValueError("pages count from 1 and end no earlier than they start")


def merged(sections: list[Section], count: Counter, config: ChunkConfig) -> Iterator[Section]:
    """Small prose sections join the next one under the same headings while both fit."""
    held: Section | None = None
    for s in sections:
        if held is not None:
            alike = held.kind == s.kind == "prose" and held.heading_path == s.heading_path
            size = count(held.text)
            if alike and size < config.min and size + count(s.text) <= config.max:
                end = s.page_end if s.page_end is not None else held.page_end
                held = replace(held, text=f"{held.text}\n\n{s.text}", page_start=held.page_start if held.page_start is not None else end, page_end=end)
                continue
            yield held
        held = s
    if held is not None:
        yield held


def by_words(text: str, budget: int, count: Counter) -> Iterator[str]:
    """Greedy runs of words; a word over the budget is a run of its own."""
    run = ""
    for word in text.split():
        longer = f"{run} {word}" if run else word
        if run and count(longer) > budget:
            yield run
            run = word
        else:
            run = longer
    if run:
        yield run


def units(text: str, budget: int, count: Counter) -> Iterator[str]:
    """Paragraphs; of one over the budget its sentences; of such a sentence runs of words."""
    for paragraph in filter(None, map(str.strip, re.split(r"\n{2,}", text))):
        if count(paragraph) <= budget:
            yield paragraph
            continue
        for sentence in filter(None, map(str.strip, _SENTENCE.split(paragraph))):
            if count(sentence) <= budget:
                yield sentence
            else:
                yield from by_words(sentence, budget, count)


def packed(parts: list[str], sizes: list[int], limit: int, overlap: int) -> Iterator[list[str]]:
    """Greedy packs of units; a pack begins with the last units of the one before, as many as fit both limits."""
    run: list[int] = []
    size = 0
    for i, n in enumerate(sizes):
        if run and size + n > limit:
            yield [parts[j] for j in run]
            tail, total = [], 0
            for j in reversed(run):
                if total + sizes[j] > min(overlap, limit - n):
                    break
                tail.insert(0, j)
                total += sizes[j]
            run, size = tail, total
        run.append(i)
        size += n
    if run:
        yield [parts[j] for j in run]


def by_lines(lines: list[str], head: list[str], budget: int, count: Counter) -> Iterator[str]:
    """Packs of lines, each begun by the head lines; a line over the budget is cut by words."""
    above = "\n".join(head)
    room = max(1, budget - (count(above) if above else 0))
    fitting = [piece for line in lines for piece in ([line] if count(line) <= room else by_words(line, room, count))]
    run: list[str] = []
    for line in fitting:
        if run and count("\n".join([*head, *run, line])) > budget:
            yield "\n".join([*head, *run])
            run = []
        run.append(line)
    if run or head:
        yield "\n".join([*head, *run])


def split_section(title: str, s: Section, count: Counter, config: ChunkConfig) -> Iterator[str]:
    crumb = lambda *parts: " › ".join(p for p in parts if p)
    prefix = crumb(title, *s.heading_path)
    prefix = f"{prefix}\n\n" if prefix else ""
    budget = config.max - count(prefix) - SAFETY
    if budget <= 0:
        prefix = f"{title}\n\n" if title else ""
        budget = max(config.max - count(prefix), config.min)
    if count(s.text) <= budget:
        yield prefix + s.text
        return
    lines = s.text.split("\n")
    if s.kind == "table":
        head = lines[:2] if len(lines) > 1 and _RULE.match(lines[1]) else []
        parts = by_lines(lines[len(head) :], head, budget, count)
    elif s.kind == "record":
        parts = by_lines(lines[1:], lines[:1], budget, count)
    else:
        limit = min(config.target, budget)
        own = list(units(s.text, limit, count))
        parts = ("\n\n".join(p) for p in packed(own, [count(u) for u in own], limit, config.overlap_tokens))
    for part in parts:
        yield prefix + part


def chunk_document(source: str, sha256: str, title: str, sections: list[Section], count: Counter = estimate, config: ChunkConfig = ChunkConfig()) -> Iterator[dict]:
    index = 0
    for s in merged(sections, count, config):
        for text in split_section(title, s, count, config):
            yield {
                "id": str(uuid.uuid5(NAMESPACE, f"{sha256}:{index}")), "source": source, "doc_sha256": sha256, "index": index, "text": text, "token_count": count(text),
                "heading_path": list(s.heading_path), "kind": s.kind, "page_start": s.page_start, "page_end": s.page_end, "row": s.row, "sheet": s.sheet, "rec_id": s.rec_id,
            }
            index += 1


CHUNK = "id string, source string, doc_sha256 string, index int, text string, token_count int, heading_path array<string>, kind string, page_start int, page_end int, row int, sheet string, rec_id string"
SECTION = "struct<text:string,heading_path:array<string>,kind:string,page_start:int,page_end:int,row:int,sheet:string,rec_id:string>"


def chunk_sections(documents: DataFrame, config: ChunkConfig = ChunkConfig(), counter: Callable[[], Counter] = lambda: estimate) -> DataFrame:
    """Chunks of documents (source, sha256, title, sections array): one row a chunk, documents one at a time.

    `counter` makes the token counter, once a task. A document is a narrow unit of work: no shuffle.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter()
        names = [c.split()[0] for c in CHUNK.split(", ")]
        for pdf in frames:
            rows = []
            for source, sha, title, sections in zip(pdf["source"], pdf["sha256"], pdf["title"], pdf["sections"]):
                own = [Section(**(dict(s) | {"heading_path": tuple(s["heading_path"]), **{k: None if s[k] is None else int(s[k]) for k in ("page_start", "page_end", "row")}})) for s in sections]
                rows += chunk_document(source, sha, title or "", own, count, config)
            out = pd.DataFrame(rows, columns=names)
            for c in ("page_start", "page_end", "row"):
                out[c] = out[c].astype("Int32")
            yield out

    return bounded(documents).select("source", "sha256", "title", F.col("sections").cast(f"array<{SECTION}>")).mapInPandas(run, CHUNK)


def pack_prose(parts: Column, limit: int, overlap: int) -> Column:
    """Packs of an array of units by estimated tokens, as arrays: the fold of `packed`, in the JVM.

    State: finished packs, the open pack, its size. The tail that begins the next pack is the longest suffix
    within min(overlap, limit - unit).
    """
    size = lambda u: estimate_tokens(u)

    def tail(run: Column, room: Column) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("n"), F.lit(True).alias("open"))

        def add(s: Column, u: Column) -> Column:
            more = s["open"] & (s["n"] + size(u) <= room)
            return F.struct(F.when(more, F.concat(F.array(u), s["kept"])).otherwise(s["kept"]).alias("kept"), F.when(more, s["n"] + size(u)).otherwise(s["n"]).alias("n"), more.alias("open"))

        return F.aggregate(F.reverse(run), start, add)

    def step(state: Column, unit: Column) -> Column:
        full = (F.size(state["run"]) > 0) & (state["n"] + size(unit) > limit)
        kept = tail(state["run"], F.least(F.lit(overlap), F.lit(limit) - size(unit)))
        return F.struct(
            F.when(full, F.concat(state["done"], F.array(state["run"]))).otherwise(state["done"]).alias("done"),
            F.when(full, F.concat(kept["kept"], F.array(unit))).otherwise(F.concat(state["run"], F.array(unit))).alias("run"),
            F.when(full, kept["n"] + size(unit)).otherwise(state["n"] + size(unit)).alias("n"),
        )

    start = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("run"), F.lit(0).alias("n"))
    return F.aggregate(parts, start, step, lambda s: F.when(F.size(s["run"]) > 0, F.concat(s["done"], F.array(s["run"]))).otherwise(s["done"]))


def prose_chunks(docs: DataFrame, config: ChunkConfig = ChunkConfig(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, index, text, token_count): each text as one prose section without a title, through `chunk_sections`. Blank texts have no chunk."""
    section = F.struct(F.col(text).alias("text"), F.array().cast("array<string>").alias("heading_path"), F.lit("prose").alias("kind"), *[F.lit(None).cast(t).alias(n) for n, t in (("page_start", "int"), ("page_end", "int"), ("row", "int"), ("sheet", "string"), ("rec_id", "string"))])
    whole = docs.filter(F.col(text).rlike(r"\S")).select(F.col(key).cast("string").alias("source"), F.sha2(F.col(text), 256).alias("sha256"), F.lit("").alias("title"), F.array(section).alias("sections"))
    return chunk_sections(whole, config).select(F.col("source").cast(docs.schema[key].dataType).alias(key), "index", "text", "token_count")
