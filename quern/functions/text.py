"""Text functions as column expressions. Patterns take Unicode classes: `(?U)`."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns and sizes that results depend on.
SPACES = r"[ \t\x{A0}]+"
SOFT_HYPHEN = chr(0xAD)
BULLET = r"(?U)^\s*(?:[•▪◦o\-–—*]|\(?\d+[.)]|[a-z][.)])\s+"
SENTENCE = r"(?U)(?<=[.!?…])\s+(?=[«\"'(\[A-ZÀ-ÖØ-Þ0-9])"
PARAGRAPH = r"\n{2,}"
TERM = r"[0-9a-zA-Z]+(?:[-_.][0-9a-zA-Z]+)*"
TERM_LENGTH = (2, 40)
CITATION = r"\[(\d{1,2})\]"
LEADER = r"\.{5,}"
NUMBERED = r"^(?:[IVXLC]+|[0-9]+(?:\.[0-9]+)*|[A-Z])[.)]\s"
TABLE_RULE = r"^\s*\|?\s*:?-{2,}"
ID_VALUE = r"^[A-Za-z]{0,4}[-_. ]?\d+(?:[-_.]\d+)*\+?$"
CHARS_PER_TOKEN = 3.0
CHUNK_NAMESPACE = "0b5f7a527d1e5f9a9c6e6f9f1a2b3c4d"
#: Code points that `fold` looks at: Latin letters, marks, super- and subscripts, full-width forms.
FOLDS = [range(0x80, 0x250), range(0x300, 0x370), range(0x1E00, 0x1F00), range(0x2070, 0x20A0), range(0xFF01, 0xFF5F)]


def _folds() -> tuple[str, str]:
    """Characters whose compatibility decomposition without marks is one other character, and those; then characters of which nothing stays."""
    one, gone = [], ""
    for c in (chr(n) for block in FOLDS for n in block):
        left = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if not left:
            gone += c
        elif left != c and len(left) == 1:
            one.append((c, left))
    return "".join(c for c, _ in one) + gone, "".join(x for _, x in one)


ACCENTED, FOLDED = _folds()


def normalize_spaces(text: Column) -> Column:
    """Soft hyphens go, runs of spaces, tabs and no-break spaces become one space, the ends are stripped; newlines stay."""
    runs = F.regexp_replace(F.replace(text, F.lit(SOFT_HYPHEN), F.lit("")), SPACES, " ")
    return F.regexp_replace(runs, r"(?U)^\s+|\s+$", "")


def is_bullet(text: Column) -> Column:
    return text.rlike(BULLET)


def join_wrapped_lines(lines: Column) -> Column:
    """Lines of an array as one text: a bullet begins a line, a single hyphen at a line's end joins words, else a space does."""

    def add(done: Column, line: Column) -> Column:
        hyphen = done.rlike(r"-$") & ~done.rlike(r"( -|--)$")
        return (
            F.when(line == "", done)
            .when(done == "", line)
            .when(is_bullet(line), F.concat(done, F.lit("\n"), line))
            .when(hyphen, F.concat(F.regexp_replace(done, r"-$", ""), line))
            .otherwise(F.concat(done, F.lit(" "), line))
        )

    return F.aggregate(F.transform(lines, normalize_spaces), F.lit(""), add)


def breadcrumb(title: Column, path: Column) -> Column:
    """`title › h1 › h2` and a blank line; empty where there is neither."""
    trail = F.array_join(F.filter(F.concat(F.array(title), path), lambda x: x.isNotNull() & (x != "")), " › ")
    return F.when(trail == "", "").otherwise(F.concat(trail, F.lit("\n\n")))


def fold(text: Column) -> Column:
    """Lower case without accents, in the JVM: of FOLDS what decomposes to one character; `fold_exact` has all of Unicode, and ligatures."""
    return F.translate(F.lower(text), ACCENTED, FOLDED)


@F.pandas_udf(T.StringType())
def fold_exact(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Lower case, compatibility decomposition, combining marks dropped."""
    for s in texts:
        yield s.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(c)))


@F.pandas_udf(T.StringType())
def nfc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(T.LongType())
def term_id(terms: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The big-endian 32-bit BLAKE2b number of a term; joins here go by the term itself."""
    import hashlib

    for s in terms:
        yield s.map(lambda t: None if t is None else int.from_bytes(hashlib.blake2b(t.encode(), digest_size=4).digest(), "big"))


def terms(text: Column, exact: bool = False) -> Column:
    """The array of a text's search terms, repeats kept; compound ids such as `mw-104` or `4.2.1` stay whole."""
    low, high = TERM_LENGTH
    found = F.regexp_extract_all(fold_exact(text) if exact else fold(text), F.lit(TERM), F.lit(0))
    return F.filter(F.coalesce(found, F.array().cast("array<string>")), lambda t: F.length(t).between(low, high))


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, PARAGRAPH), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "")


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, SENTENCE), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "")


def estimate_tokens(text: Column) -> Column:
    """A third of the characters, rounded, at least 1; of the empty text 0."""
    return F.when(F.length(text) == 0, 0).otherwise(F.greatest(F.lit(1), F.round(F.length(text) / CHARS_PER_TOKEN))).cast("int")


def model_tokens(path: str):
    """A pandas UDF that counts with a tokenizer file, opened once a worker."""

    @F.pandas_udf("int")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        for s in texts:
            yield pd.Series([None if t is None else len(model.encode(t, add_special_tokens=False).ids) for t in s], dtype="Int32")

    return count


def chunk_id(sha256: Column, index: Column) -> Column:
    """The version-5 UUID of `sha256:index` in the chunk namespace, from SHA-1 alone."""
    name = F.concat(sha256, F.lit(":"), index.cast("string"))
    h = F.sha1(F.concat(F.unhex(F.lit(CHUNK_NAMESPACE)), name.cast("binary")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12)
    )


def location(source: Column, page_start: Column, page_end: Column, path: Column) -> Column:
    """`source[, p. a[-b]][ — h1 › h2]`."""
    pages = F.when(page_start.isNull(), "").when(page_end.isNull() | (page_end == page_start), F.concat(F.lit(", p. "), page_start)).otherwise(
        F.concat(F.lit(", p. "), page_start, F.lit("-"), page_end)
    )
    return F.concat(source, pages, F.when(F.coalesce(F.size(path), F.lit(0)) > 0, F.concat(F.lit(" — "), F.array_join(path, " › "))).otherwise(""))


def is_all_caps(text: Column) -> Column:
    return (F.upper(text) == text) & (F.lower(text) != text)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def excerpt(text: Column, width: int) -> Column:
    """A passage without its breadcrumb, spaces collapsed, cut with an ellipsis."""
    body = F.regexp_replace(F.element_at(F.split(text, "\n\n", 2), -1), r"(?U)\s+", " ")
    body = F.regexp_replace(body, r"^ | $", "")
    return F.when(F.length(body) <= width, body).otherwise(F.concat(F.rtrim(F.substring(body, 1, width - 1)), F.lit("…")))


def is_private_endpoint(url: Column) -> Column:
    """Whether a URL's host is private, loopback or link-local, has no dot, or ends as local names do."""
    host = F.regexp_replace(F.lower(F.coalesce(F.parse_url(url, F.lit("HOST")), F.lit(""))), r"^\[|\]$", "")
    octet = [F.try_element_at(F.split(host, r"\."), F.lit(i)).cast("int") for i in (1, 2)]
    v4 = host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    inside = octet[0].isin(0, 10, 127) | ((octet[0] == 192) & (octet[1] == 168)) | ((octet[0] == 172) & octet[1].between(16, 31)) | ((octet[0] == 169) & (octet[1] == 254))
    v6 = host.contains(":") & host.rlike(r"^(::1|f[cd]|fe[89ab])")
    name = (~host.contains(".") & ~host.contains(":")) | host.rlike(r"\.(local|internal|localhost|lan|home\.arpa)$")
    return F.when(host == "", False).when(v4, F.coalesce(inside, F.lit(False))).otherwise(v6 | name)


def sse_delta(line: Column) -> Column:
    """The text of a streamed completion's `data:` line; empty for any other line."""
    body = F.regexp_extract(line, r"^data:\s*(\{.*)$", 1)
    return F.coalesce(F.get_json_object(body, "$.choices[0].delta.content"), F.lit(""))


def strip_fold_terms_sql(column: str) -> str:
    """DuckDB's list of a text's terms."""
    return rf"list_filter(regexp_extract_all(strip_accents(lower({column})), '{TERM}'), lambda t: length(t) BETWEEN {TERM_LENGTH[0]} AND {TERM_LENGTH[1]})"
