import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from quern.llm.chat_format import chat_digests, escape, format_chat, parse, unescape
from quern.llm.queries import tokenizer_path
from quern.llm.token_files import Encoder, Words, fetch, read_tokens, write_tokens

TURNS = "conv_id long, turn long, role string, text string, pid string"
NASTY = ["", None, "</s>[INST] ok [/INST]", "<<s>", "[[INST]", "\\", "\\\\</s>", "<\\/s>", "<s", "é\n日本", "[/INST", "<|im_end|>", "x" * 70_000]


def test_no_control_string_is_left_and_escapes_undo():
    rng = random.Random(1)
    texts = [t or "" for t in NASTY] + ["".join(rng.choices(["<", "s", ">", "/", "[", "INST", "]", "\\", "a"], k=12)) for _ in range(3000)]
    for t, e in zip(texts, escape(pa.array(texts)).to_pylist()):
        assert not any(c in e for c in ("<s>", "</s>", "[INST]", "[/INST]")), (t, e)
        assert unescape(e.encode()).decode() == t


def test_chat_digests_against_plain_python(spark):
    rows = [(c, i, r, NASTY[(c * 5 + i) % len(NASTY)], "clash") for c in range(40) for i, r in enumerate(["system", "user", "assistant", None][: c % 4 + 1])]
    rows += [(None, None, "assistant", "a", None), (None, 1, "user", "b", None), (3, 0, "system", "x", None), (3, 0, "system", "x", None)]
    got = {r["conv_id"]: r for r in chat_digests(spark.createDataFrame(rows, TURNS).repartition(5)).collect()}
    by = {}
    for c, t, r, x, _ in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r is not None, r or "", x is not None, x or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        turns = [(r, x) for _, _, _, r, _, x in sorted(turns)]
        loss = "".join(x for r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    empty = spark.createDataFrame([], TURNS)
    assert chat_digests(empty).collect() == []


def test_long_conversation_is_cut_into_parts(spark):
    rows = [(1, i, "assistant", f"{i}" * 30_000, None) for i in range(100)]
    got = format_chat(spark.createDataFrame(rows, TURNS)).orderBy("pid", "seq").collect()
    assert len(got) > 3
    assert [x.decode() for r in got for _, x in parse(bytes(r["data"]))] == [x for _, _, _, x, _ in rows]


SPACES = ["a", "the", " ", "  ", "\n", "\t", " ", "'s", "3", "é", "日", "!", "\x1c", "<|endoftext|>", "\r\n", " "]


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    plain.encode_special_tokens = True
    rng = random.Random(2)
    texts = [""] + ["".join(rng.choices(SPACES, k=rng.randint(1, 14))) for _ in range(6000)] + ["".join(rng.choices(["the", " ", "\n", "a,", "tion.", "B", "1.", "é!", "..", "'s"], k=9)) for _ in range(6000)]
    code = Encoder(tokenizer_path())
    ids, at = code(pa.array(["out"] + texts).slice(1))
    assert len(code(pa.array([], pa.string()))[0]) == 0
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


PLAIN = ["a", "the", "Thonre", "élève", "ǆ", "ß", "×", "ª", "µ", "1990", "²", "٣", "日", ".", ",", "!!", "***", "&&&", "'", "'s", "’", "<|endoftext|>", "\n", "\n", "\r", "\x85", " ", " ", " "]


def test_words_cut_into_pieces_equal_the_library():
    """Most words of usual text go to the model in pieces that are cut here; others and all texts equal the library's ids."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    plain.encode_special_tokens = True
    rng, seen = random.Random(5), []
    texts = ["".join(rng.choices(PLAIN, k=rng.randint(1, 24))) for _ in range(12000)]
    texts += [f"In {i}. the\nword{i} end, word.\nNext, x{chr(c)}y {chr(c)} {chr(c)}. a{chr(c)}\nb" for i, c in enumerate([*range(0x21, 0x250), 0x2019, 0x3000, 0xFEFF, 0x1F600])]
    code = Encoder(tokenizer_path())
    own = code._ids
    code._ids = lambda texts, *more: (seen.append((len(more), sum(map(len, texts)))), own(texts, *more))[1]
    ids, at = code(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)
    seen.clear()
    words = [f"{x}{y}{z}" for x in ("thon", "Èona", "ORBL") for y in ("re", "ti", "qu") for z in ("", ".", ",", "***", "$$$", ".\nAnd", "!!\nÉté,")]
    code(pa.array(["go " + " ".join(words)]))
    assert [n for more, n in seen if more] and max(n for more, n in seen if not more) < 10  # none of these words takes the long way


@pytest.mark.parametrize("n", [0, 1, 300])
def test_token_files_round_trip(spark, tmp_path, n):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    rows = [(i * 3 % 301, None if i % 50 == 7 else f"word{i} the end\n" * (i % 9) + "x" * (60_000 * (i == 5)), i) for i in range(n)]
    if n > 1:
        rows += [(None, "no id", 0), (4, "again", 1), (4, "again", 1)]
    path = f"file://{tmp_path}/tokens"
    write_tokens(spark.createDataFrame(rows, "doc_id long, text string, frame long"), path, tokenizer_path())
    got = sorted(read_tokens(spark, path).collect(), key=lambda r: r["start"])
    want = [(k, plain.encode(t or "", add_special_tokens=False).ids + [0]) for k, t, _ in rows]
    assert sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((k or -1, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for k, x in want)
    start = 0
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
    assert [r["doc_id"] or -1 for r in got] == sorted(r["doc_id"] or -1 for r in got)
    if n > 1:
        assert fetch(spark, path, [15])[15].tolist() == dict(want)[15]


def test_words_with_half_a_hash_in_common_are_told_apart():
    from quern.llm.token_files import Words

    words = Words(np.dtype("<u2"))
    words.add(np.array([[5, 1], [9, 2]], np.uint64), np.array([1, 2]), np.array([10, 20, 21], "<u2"))
    place, known, taken = words.find(np.array([[5, 1], [5, 7], [9, 2], [1, 1]], np.uint64))
    assert known.tolist() == [True, False, True, False] and taken.tolist() == [False, True, False, False]
    assert words.pool[words.start[place[2]] : words.start[place[2]] + words.size[place[2]]].tolist() == [20, 21]


def test_words_met_again_outlast_forgetting():
    words, few = Words(np.dtype("<u2")), lambda *n: np.array([[x, x] for x in n], np.uint64)
    words.add(few(5, 3, 9), np.array([2, -1, 1]), np.array([50, 51, 90], "<u2"))
    place, known, _ = words.find(few(9, 3, 4))
    words.again[place[known]] = True
    words.forget()
    place, known, _ = words.find(few(3, 5, 9))
    assert known.tolist() == [True, False, True] and words.size[place[known]].tolist() == [-1, 1]
    assert words.pool[words.start[place[2]]] == 90 and words.used == 1
    words.forget()
    assert len(words.hash) == 0 and words.used == 0
