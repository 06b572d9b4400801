"""Token ids in compressed binary blocks with a shared dictionary.

Format, a Parquet table `blocks` of one row a block, in ascending order of doc_id by (pid, seq):
doc_ids, token counts and the end offset of each document's frame in `payload`; `width`, the bytes of an id
(little-endian, unsigned); `dict_hash`, the name of the dictionary in the table `dictionary`. A frame is
one document's ids under zstandard with that dictionary, so a reader takes the one frame it needs.
Spark writes and commits the files, so they can be in any store and a lost task is run again.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import itertools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .stage import Stage, parts, tidy

#: Documents that the dictionary is trained on (those with the smallest hashes of their ids), bytes of the one sample of each, bytes of the dictionary.
DICT_DOCS, DICT_PIECE, DICT_BYTES = 2000, 4096, 64 << 10
#: A block is closed at this many bytes or documents.
BLOCK_BYTES, BLOCK_DOCS = 1 << 20, 4096
#: Words whose ids a worker remembers; beyond, it forgets those that it has not met again since it last did.
WORDS = 400_000
#: How the vocabulary writes a space.
SPACE = chr(0x120)
LEVEL = 3

# Code points of white space besides space and newline, in Unicode's and the tokenizer's reading.
_SPACES = [9, 11, 12, 13, 0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_OTHER_SPACE = re.compile("[" + "".join(map(chr, _SPACES)) + "]")
# Words whose pieces are plain to see: Latin letters or digits, then signs, then a line's end and the same again. No apostrophe.
_SIGNS, _RUN = r"[!-&(-/:-@\[-`{-~]", "(?:[A-Za-zÀ-ÖØ-öø-ɏ]+|[0-9]+)"
_PLAIN = rf"\A{_RUN}(?:{_SIGNS}+(?:\n{_RUN}{_SIGNS}*)?)?\z"
_BEGINS = re.compile(rf"{_SIGNS}+".encode())
_CUT = 0xFF  # a byte that UTF-8 doesn't have
_KEPT = {*range(33, 127), *range(161, 173), *range(174, 256)}
#: How the vocabulary writes each byte, and a space for a cut.
_WRITTEN = "".join(" " if b == _CUT else chr(b if b in _KEPT else 256 + sum(x not in _KEPT for x in range(b))) for b in range(256))


class Words:
    """Ids of words by the words' 96-bit hashes, in columns sorted by 64 bits of them: some 20 bytes a word.

    A word with these bits of another's hash but not the rest is not known, and can't be added.
    """

    def __init__(self, dtype: np.dtype):
        self.check, self.again = np.empty(0, np.uint32), np.empty(0, bool)
        self.hash, self.start, self.size = np.empty(0, np.uint64), np.empty(0, np.uint32), np.empty(0, np.int32)
        self.pool, self.used = np.empty(1 << 16, dtype), 0

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of rows of hashes, whether a word is known, and whether another word is in its place."""
        if not len(self.hash):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)
        order, at = np.argsort(hashes[:, 0]), np.empty(len(hashes), np.int64)
        at[order] = np.minimum(np.searchsorted(self.hash, hashes[order, 0]), len(self.hash) - 1)  # in order: near places are in the cache
        half = self.hash[at] == hashes[:, 0]
        known = half & (self.check[at] == hashes[:, 1].astype(np.uint32))
        return at, known, half & ~known

    def behind(self, ids: np.ndarray) -> None:
        """Puts ids behind those of the words; what is put next takes their place."""
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.empty(len(ids) + self.used // 4 + (1 << 16), self.pool.dtype)])
        self.pool[self.used : self.used + len(ids)] = ids

    def add(self, hashes: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """New words and their ids, one word's after the other's; size -1 and no ids for what can't be encoded apart."""
        self.behind(ids)
        took = np.maximum(sizes, 0)
        order = np.argsort(hashes[:, 0], kind="stable")
        both = np.concatenate([self.hash, hashes[order, 0]])
        merged = np.argsort(both, kind="stable")
        self.hash, self.check = both[merged], np.concatenate([self.check, hashes[order, 1].astype(np.uint32)])[merged]
        self.start = np.concatenate([self.start, (self.used + np.cumsum(took) - took)[order].astype(np.uint32)])[merged]
        self.size = np.concatenate([self.size, sizes[order].astype(np.int32)])[merged]
        self.again = np.concatenate([self.again, np.zeros(len(order), bool)])[merged]
        self.used += len(ids)

    def forget(self) -> None:
        """Keeps the words that were met again, with their ids."""
        kept = np.flatnonzero(self.again)
        took = np.maximum(self.size[kept], 0).astype(np.int64)
        start = np.cumsum(took) - took
        self.pool = self.pool[np.repeat(self.start[kept] - start, took) + np.arange(took.sum())]
        self.hash, self.check, self.size, self.start = self.hash[kept], self.check[kept], self.size[kept], start.astype(np.uint32)
        self.used, self.again = len(self.pool), np.zeros(len(kept), bool)


class Encoder:
    """`encode_batch` of a byte-level tokenizer file, word by word from memory where that is exact.

    The tokenizer cuts before a space that follows a non-space. So a text whose spaces all stand between
    non-spaces is its words, each encoded once; other texts go to the tokenizer whole. Words are split,
    numbered and put together again as columns.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        self.width = 2 if max(vocabulary.values()) < 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        # the same model over pieces cut here, for words that are plain
        self.cut = None
        own = self.tokenizer.pre_tokenizer
        if isinstance(own, pre_tokenizers.ByteLevel) and own.use_regex and self.tokenizer.normalizer is None:
            self.cut = Tokenizer(self.tokenizer.model)
            self.cut.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for t, i in vocabulary.items() if t[0] == SPACE]] = True
        self.words = Words(self.dtype)  # after a space

    def _ids(self, texts: list[str], tokenizer=None) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in (tokenizer or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: pa.Array, hashes: np.ndarray) -> None:
        """Encodes many words in one text: an id whose token begins with a space begins the next word."""
        plain = np.zeros(len(new), bool) if self.cut is None else pc.match_substring_regex(new, _PLAIN).to_numpy(zero_copy_only=False)
        order = np.argsort(~plain, kind="stable")
        words, count = new.to_numpy(zero_copy_only=False)[order].tolist(), int(plain.sum())
        sizes, ids = [], []
        for at in range(0, count, 1024):
            part = words[at : min(at + 1024, count)]
            text = _BEGINS.sub(b"\xff\\g<0>", f" {' '.join(part)}".encode()).replace(b" ", b"\xff ").replace(b"\n", b"\xff\n\xff")
            own = self._ids([codecs.charmap_decode(text, "strict", _WRITTEN)[0]], self.cut)[0]
            sizes.append(np.diff(np.append(np.flatnonzero(self.opens[own]), len(own))))
            ids.append(own)
            if len(sizes[-1]) != len(part):
                raise AssertionError("a plain word's ids don't begin with a space")
        for at in range(count, len(words), 4096):
            part = words[at : at + 4096]
            text = " ".join(part)
            odd = None
            if not text or "  " in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n" or _OTHER_SPACE.search(text):
                odd = np.array([is_odd(w) for w in part])
                text = " ".join(w for w, o in zip(part, odd.tolist()) if not o)
            own = self._ids([f" {text}"])[0] if text else np.empty(0, self.dtype)
            size = np.diff(np.append(np.flatnonzero(self.opens[own]), len(own)))
            if odd is not None:
                whole = np.full(len(part), -1)
                whole[~odd] = size
                size = whole
            if len(size) != len(part):
                raise AssertionError("a token that begins with a space stands inside a word")
            sizes.append(size)
            ids.append(own)
        self.words.add(hashes[order], np.concatenate(sizes), np.concatenate(ids))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (strings, no nulls) in one array, and where each text's begin and the last one's end."""
        if len(self.words.hash) > WORDS:
            self.words.forget()
        n = len(texts)
        parts = pc.split_pattern(texts.cast(pa.large_string()), " ")
        at = parts.offsets.to_numpy()
        flat = parts.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
        at = at - at[0]
        number = flat.indices.to_numpy(zero_copy_only=False)
        words = flat.dictionary.to_numpy(zero_copy_only=False).tolist()  # strings made by Arrow, not one by one here
        firsts = at[:-1]
        later = np.ones(len(number), bool)
        later[firsts] = False
        used = np.zeros(len(words), bool)
        used[number[later]] = True
        hashes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.uint64).reshape(-1, 2)
        place, known, taken = self.words.find(hashes)
        self.words.again[place[known]] = True
        new = np.flatnonzero(used & ~known & ~taken)
        if len(new):
            self._learn(flat.dictionary.take(pa.array(new)), hashes[new])
            place, known, taken = self.words.find(hashes)
        # of the words their places in the pool; first words of texts and whole texts behind it
        size = np.where(known, self.words.size[place], 0) if len(self.words.hash) else np.zeros(len(words), np.int32)
        start = np.where(known, self.words.start[place], 0).astype(np.int64) if len(self.words.hash) else np.zeros(len(words), np.int64)
        first_words = [words[i] for i in number[firsts].tolist()]
        whole = np.array([bool(w) and is_odd(w) for w in first_words], bool)
        if n:
            whole |= np.logical_or.reduceat(((size < 0) | (used & ~known))[number] & later, firsts)
        own = self._ids(["" if w else f for f, w in zip(first_words, whole.tolist())])
        rest = self._ids([texts[int(i)].as_py() for i in np.flatnonzero(whole)])
        more = np.array([len(x) for x in [*own, *rest]], np.int64)
        behind = self.words.used + np.cumsum(more) - more
        self.words.behind(np.concatenate([np.empty(0, self.dtype), *own, *rest]))
        took, begin = np.maximum(size, 0).astype(np.int64)[number], start[number]
        took[firsts], begin[firsts] = more[:n], behind[:n]
        if whole.any():
            took[np.repeat(whole, np.diff(at))] = 0
            took[firsts[whole]], begin[firsts[whole]] = more[n:], behind[n:]
        ends = np.concatenate([[0], np.cumsum(took)])
        kind = np.int32 if max(len(self.words.pool), ends[-1]) < 1 << 31 else np.int64
        index = np.repeat((begin - ends[:-1]).astype(kind), took)
        index += np.arange(len(index), dtype=kind)
        return self.words.pool[index], ends[np.concatenate([firsts, [len(number)]])]


def is_odd(word: str) -> bool:
    """Whether a word can't be encoded apart from what stands around it."""
    return not word or word[0] == "\n" or word[-1] == "\n" or bool(_OTHER_SPACE.search(word))


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _encoded(batches: Iterator[pa.RecordBatch], code: Encoder, end_id: int, limit: int = 3 << 20) -> Iterator[tuple[pa.Array, list[bytes], np.ndarray]]:
    """Keys, ids with the end id as bytes, and numbers of ids, a few MB of text at a time."""
    end = np.array([end_id], code.dtype).tobytes()
    for batch in batches:
        texts = pc.fill_null(batch["text"], "")
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        cut = [0, *(np.flatnonzero(np.diff(size // limit)) + 1).tolist(), batch.num_rows]
        for lo, hi in itertools.pairwise(cut):
            if hi > lo:
                ids, at = code(texts.slice(lo, hi - lo))
                data, at = ids.tobytes(), at * code.width
                yield batch["doc_id"].slice(lo, hi - lo), [data[a:b] + end for a, b in itertools.pairwise(at.tolist())], np.diff(at) // code.width + 1


def _train(path: str, end_id: int):
    def train(batches):
        code, samples, size = encoder(path), [], 0
        for _, held, _ in _encoded(batches, code, end_id):
            for ids in held:
                # one piece of each document, from a place that its ids decide
                at = zlib.crc32(ids) % max(1, -(-len(ids) // DICT_PIECE)) * DICT_PIECE
                samples.append(ids[at : at + DICT_PIECE])
                size += len(samples[-1])
        try:
            data = zstandard.train_dictionary(min(DICT_BYTES, max(1024, size // 8)), samples).as_bytes()
        except zstandard.ZstdError:  # too few samples: a dictionary of raw content
            data = b"".join(samples)[:DICT_BYTES].ljust(8, b"\0")
        yield pa.RecordBatch.from_pydict({"dict_hash": [hashlib.sha256(data).hexdigest()], "data": [data]})

    return train


def _frames(path: str, end_id: int, dictionary: bytes):
    def frames(batches):
        code = encoder(path)
        zip_ = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=False)
        for keys, held, n in _encoded(batches, code, end_id):
            yield pa.RecordBatch.from_arrays([keys, pa.array(n), pa.array(map(zip_.compress, held), pa.binary())], names=["doc_id", "n_tokens", "frame"])

    return frames


BLOCKS = "pid int, seq long, first_id long, last_id long, tokens long, doc_ids array<long>, counts array<long>, ends array<int>, width int, dict_hash string, payload binary"


def _blocks(width: int, dict_hash: str):
    names = [x.split()[0] for x in BLOCKS.split(", ")]

    def blocks(batches):
        pid, seq = TaskContext.get().partitionId(), 0
        keys, counts, frames, size = [], [], [], 0

        def close():
            known = [k for k in keys if k is not None]
            row = [pid, seq, min(known, default=None), max(known, default=None), sum(counts), keys, counts, np.cumsum([len(x) for x in frames]).tolist(), width, dict_hash, b"".join(frames)]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32(), pa.string(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=names)

        for batch in batches:
            for k, n, frame in zip(*(batch[c].to_pylist() for c in ("doc_id", "n_tokens", "frame"))):
                keys.append(k)
                counts.append(n)
                frames.append(frame)
                size += len(frame)
                if size >= BLOCK_BYTES or len(keys) >= BLOCK_DOCS:
                    yield close()
                    seq += 1
                    keys, counts, frames, size = [], [], [], 0
        if keys:
            yield close()

    return blocks


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, key: str = "doc_id", text: str = "text") -> None:
    """Writes the ids of every whole text, `end_id` after each, to the tables `path`/blocks and `path`/dictionary.

    Nulls: a null text is empty and gives the end id alone; null keys come first. Empty texts likewise.
    Rows that repeat a key are documents of their own, ordered by their frames. Only key and text are
    read. An empty table gives a table without blocks.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "tokens")
    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    # about twice as many as are taken reach the one task that trains, however many tasks read the table
    share = min(1.0, 2 * DICT_DOCS / max(1, rows.count()))
    draw = F.xxhash64("doc_id")
    sample = rows.filter(draw.cast("double") <= (2 * share - 1) * 2.0**63).orderBy(draw, "doc_id", "text").limit(DICT_DOCS).coalesce(1)
    dictionary = sample.mapInArrow(tidy(_train(tokenizer, end_id)), "dict_hash string, data binary")
    dictionary.write.mode("overwrite").parquet(f"{path}/dictionary")
    held = spark.read.parquet(f"{path}/dictionary").first()
    data, name = (bytes(held["data"]), held["dict_hash"]) if held else (b"\0" * 8, "")
    frames = stage.write(rows.mapInArrow(tidy(_frames(tokenizer, end_id, data)), "doc_id long, n_tokens long, frame binary"), "frames")
    order = frames.repartitionByRange(parts(spark), "doc_id").sortWithinPartitions("doc_id", "n_tokens", "frame")
    order.mapInArrow(tidy(_blocks(encoder(tokenizer).width, name)), BLOCKS).write.mode("overwrite").parquet(f"{path}/blocks")
    stage.drop("frames")


def _open(dictionary: dict[str, bytes]):
    return {k: zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(v)) for k, v in dictionary.items()}


def documents_of(row: dict, tools: dict, only: set | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(doc_id, ids) of a block's documents, or of those in `only`; other frames are not decompressed."""
    at = 0
    for k, n, end in zip(row["doc_ids"], row["counts"], row["ends"]):
        if only is None or k in only:
            raw = tools[row["dict_hash"]].decompress(row["payload"][at:end], max_output_size=max(1, n * row["width"]))
            yield k, np.frombuffer(raw, f"<u{row['width']}")
        at = end


def _dictionaries(spark: SparkSession, path: str) -> dict[str, bytes]:
    return {r["dict_hash"]: bytes(r["data"]) for r in spark.read.parquet(f"{path}/dictionary").collect()}  # one a write


def fetch(spark: SparkSession, path: str, doc_ids: list[int]) -> dict[int, np.ndarray]:
    """The ids of a few documents. The bounds of the blocks keep all other blocks unread."""
    tools, want = _open(_dictionaries(spark, path)), set(doc_ids)
    blocks = spark.read.parquet(f"{path}/blocks")
    near = blocks.filter(" or ".join(f"(first_id <= {int(i)} and last_id >= {int(i)})" for i in doc_ids) or "false")
    return {k: ids for row in near.toLocalIterator() for k, ids in documents_of(row.asDict(), tools, want)}


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row a document, decoded from the files: doc_id, start, n_tokens, ids_crc32.

    `start` counts the ids of all documents before it: running sums over partitions of the order, then over
    the blocks of a partition, then inside the block.
    """
    dictionary = _dictionaries(spark, path)
    blocks = spark.read.parquet(f"{path}/blocks")
    index = blocks.select("pid", "seq", "tokens")
    sums = index.groupBy("pid").agg(F.sum("tokens").alias("n")).select("pid", (F.sum("n").over(Window.orderBy("pid")) - F.col("n")).alias("before"))
    index = index.withColumn("inside", F.sum("tokens").over(Window.partitionBy("pid").orderBy("seq")) - F.col("tokens"))
    index = index.join(F.broadcast(sums), "pid").select(F.col("pid").alias("p"), F.col("seq").alias("s"), (F.col("before") + F.col("inside")).alias("block_start"))

    def decode(batches):
        tools = _open(dictionary)
        for batch in batches:
            for row in batch.to_pylist():
                got = [(k, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for k, ids in documents_of(row, tools)]
                n = np.array([x[1] for x in got])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["pid"]] * len(got), pa.int32()),
                        pa.array([row["seq"]] * len(got), pa.int64()),
                        pa.array([x[0] for x in got], pa.int64()),
                        pa.array(np.cumsum(n) - n, pa.int64()),
                        pa.array(n, pa.int64()),
                        pa.array([x[2] for x in got], pa.int64()),
                    ],
                    names=["pid", "seq", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    rows = blocks.mapInArrow(tidy(decode), "pid int, seq long, doc_id long, inside long, n_tokens long, ids_crc32 long")
    out = rows.join(index, (rows["pid"] == index["p"]) & (rows["seq"] == index["s"]))
    return out.select("doc_id", (F.col("block_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
