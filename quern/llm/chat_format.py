r"""Chat formatting by columnar byte assembly.

A turn is `<s>[INST]` role `[/INST]` text `</s>`. Inside roles and texts a backslash is doubled, and each
string that could be read as a control string gets a backslash after its first character, so that no
control string is left in them; `unescape` undoes both.

A batch of sorted turns becomes one preallocated buffer: segment lengths give cumulative offsets, headers
are scattered as a block, contents are copied by index. Conversations are slices of that buffer.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .stage import Stage, parts, tidy

# The template's control strings.
OPEN, CLOSE, END = b"<s>[INST]", b"[/INST]", b"</s>"
CONTROL = r"([<\[])(/?s>|/?INST\]|/?<?/?SYS>>|\|[a-z_]+\|>)"
#: A conversation longer than this many bytes is written as several parts.
PART_BYTES = 1 << 20

FORMATTED = "conv_id long, pid int, seq long, n_turns int, data binary, loss array<struct<start:int,size:int>>"
_TURN = re.compile(re.escape(OPEN) + rb"(.*?)" + re.escape(CLOSE) + rb"(.*?)" + re.escape(END), re.DOTALL)


def escape(column: pa.Array) -> pa.Array:
    column = pc.replace_substring(column, "\\", "\\\\")
    return pc.replace_substring_regex(column, CONTROL, r"\1\\\2")


def unescape(data: bytes) -> bytes:
    return re.sub(rb"\\(.)", rb"\1", data, flags=re.DOTALL) if b"\\" in data else data


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and bytes of a string column without nulls."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(data) else np.empty(0, np.uint8)
    return at - at[0], flat


def assemble(role: pa.Array, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The buffer, the start of each turn and the end of the last, and the start and length of each text."""
    pieces = [_bytes(escape(pc.fill_null(c.cast(pa.string()), ""))) for c in (role, text)]
    (role_at, role_data), (text_at, text_data) = pieces
    n = len(role_at) - 1
    role_size, text_size = np.diff(role_at), np.diff(text_at)
    turn = np.zeros(n + 1, np.int64)
    np.cumsum(len(OPEN) + role_size + len(CLOSE) + text_size + len(END), out=turn[1:])
    role_start = turn[:-1] + len(OPEN)
    close_start = role_start + role_size
    text_start = close_start + len(CLOSE)
    out = np.empty(turn[-1], np.uint8)
    for start, mark in ((turn[:-1], OPEN), (close_start, CLOSE), (text_start + text_size, END)):
        out[start[:, None] + np.arange(len(mark))] = np.frombuffer(mark, np.uint8)
    for start, at, data in ((role_start, role_at, role_data), (text_start, text_at, text_data)):
        out[np.repeat(start - at[:-1], np.diff(at)) + np.arange(len(data))] = data
    return out, turn, text_start, text_size


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pid, seq = TaskContext.get().partitionId(), 0
    kind = pa.schema([("conv_id", pa.int64()), ("pid", pa.int32()), ("seq", pa.int64()), ("n_turns", pa.int32()), ("data", pa.binary()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("size", pa.int32())])))])
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        out, turn, text_start, text_size = assemble(batch["role"], batch["text"])
        conv = pc.fill_null(batch["conv_id"], 0).to_numpy(zero_copy_only=False)
        null = pc.is_null(batch["conv_id"]).to_numpy(zero_copy_only=False)
        # a part ends with its conversation, or where the running size passes a multiple of the limit
        new = np.flatnonzero((conv[1:] != conv[:-1]) | (null[1:] != null[:-1]) | (turn[1:-1] // PART_BYTES != turn[:-2] // PART_BYTES)) + 1
        first = np.concatenate([[0], new])
        edge = np.concatenate([first, [n]])
        learnt = pc.fill_null(pc.equal(batch["role"], "assistant"), False).to_numpy(zero_copy_only=False)
        part = np.searchsorted(first, np.arange(n), "right") - 1
        spans = np.flatnonzero(learnt)
        loss = pa.ListArray.from_arrays(
            pa.array(np.searchsorted(spans, edge), pa.int32()),
            pa.StructArray.from_arrays([pa.array(text_start[spans] - turn[first[part[spans]]], pa.int32()), pa.array(text_size[spans], pa.int32())], ["start", "size"]),
        )
        data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(turn[edge].copy()), pa.py_buffer(out)]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([batch["conv_id"].take(pa.array(first)), pa.array(np.full(len(first), pid), pa.int32()), pa.array(np.arange(seq, seq + len(first))), pa.array(np.diff(edge), pa.int32()), data, loss], schema=kind)
        seq += len(first)


def format_chat(turns: DataFrame) -> DataFrame:
    """Parts of formatted conversations: conv_id, pid, seq, n_turns, data, loss.

    A conversation is its parts in order of (pid, seq). `loss` lists the bytes under the loss mask in each
    part: the texts of assistant turns. Turns are dealt by ranges of (conv_id, turn), so one long
    conversation is split over tasks; no task holds more than a batch.

    Nulls: a null text or role is empty, a null turn comes first, rows with a null conv_id are one
    conversation. Rows with equal turns are ordered by role and text; repeated rows are turns of their own.
    Only conv_id, turn, role and text are read. An empty table gives an empty table.
    """
    rows = turns.select(turns["conv_id"].cast("long"), turns["turn"], turns["role"].cast("string"), turns["text"].cast("string"))
    rows = rows.repartitionByRange(parts(turns.sparkSession), "conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(tidy(_format), FORMATTED)


def parse(data: bytes) -> list[tuple[bytes, bytes]]:
    """(role, text) of each turn of formatted bytes."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(data)]


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    rows: list[list] = []
    conv, state = object(), None

    def close():
        if state:
            rows.append([conv, state["n"], state["turns"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["all"]])

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], names=names)
        rows.clear()
        return out

    for batch in batches:
        for of, data, loss in zip(batch["conv_id"].to_pylist(), batch["data"].to_pylist(), batch["loss"].to_pylist()):
            if of != conv or not state:
                close()
                conv, state = of, {"n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "all": 0}
            for role, text in parse(data):
                state["n"] += 1
                state["turns"].update(role + b"\n" + text + b"\n")
            for span in loss:
                text = unescape(data[span["start"] : span["start"] + span["size"]])
                state["chars"] += len(text.decode())
                state["loss"].update(text)
            state["all"] += len(data.decode())
        if len(rows) >= 1000:
            yield flush()
    close()
    if rows:
        yield flush()


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted bytes hold, by conversation: digests of turns and of the text under the mask.

    The bytes of a conversation stream through one task in order, as a digest needs; nothing is gathered.
    """
    rows = formatted.repartition(parts(formatted.sparkSession), "conv_id").sortWithinPartitions("conv_id", "pid", "seq")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return rows.select("conv_id", "data", "loss").mapInArrow(tidy(_digest), schema)


def chat_digests(turns: DataFrame) -> DataFrame:
    """`format_chat`, written, then `read_back`."""
    return read_back(Stage(turns.sparkSession, "chat").write(format_chat(turns), "formatted"))
