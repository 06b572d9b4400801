"""Quality classifier: a regularised quadratic discriminant over document statistics.

A text becomes a vector of transformed statistics. Each class is a Gaussian whose covariance is shrunk
towards the pooled one and towards its own diagonal; a score is the posterior from the difference of the
two log densities, with Mahalanobis distances by Cholesky factors that are computed once. Only sums over
labelled rows are gathered: their number depends on the number of statistics alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stage import Stage, tidy

# Classes of bytes.
_PUNCTUATION = b".,;:!?'\"()-"
_CLASS = np.zeros((256, 7))
for _b in range(256):
    _c = bytes([_b])
    _CLASS[_b, 0 if _c.isupper() else 1 if _c.islower() else 2 if _c.isdigit() else 3 if _c in b" \t\r\x0b\x0c" else 4 if _c == b"\n" else 5 if _c in _PUNCTUATION else 6] = _b < 128
#: Names of the statistics, in the order of the vector.
STATISTICS = (
    "log_bytes", "upper", "lower", "digits", "spaces", "newlines", "punctuation", "symbols", "beyond_ascii", "entropy",
    "word_length", "word_deviation", "longest_word", "distinct_words", "words_a_line", "distinct_lines", "packed", "short_words",
)
D = len(STATISTICS)


def statistics(texts: list[str]) -> np.ndarray:
    """A row of transformed statistics a text: logarithms of counts, arc sines of the roots of shares."""
    n = len(texts)
    raw = [t.encode() for t in texts]
    hist = np.zeros((n, 256))
    more = np.zeros((n, 8))
    pack = zstandard.ZstdCompressor(level=1)
    for i, b in enumerate(raw):
        if not b:
            continue
        hist[i] = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
        words, lines = b.split(), [x for x in b.split(b"\n") if x]
        if words:
            size = np.fromiter(map(len, words), np.float64, len(words))
            more[i, :4] = size.mean(), size.std(), size.max(), len(set(words)) / len(words)
            more[i, 7] = (size <= 3).mean()
        more[i, 4:7] = len(words) / max(1, len(lines)), len(set(lines)) / max(1, len(lines)), min(1.0, len(pack.compress(b)) / len(b))
    total = np.maximum(hist.sum(1), 1)
    share = hist / total[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = -np.where(share > 0, share * np.log2(share), 0).sum(1)
    root = lambda x: np.arcsin(np.sqrt(np.clip(x, 0, 1)))
    classes = share @ _CLASS
    out = [np.log1p(hist.sum(1)), *root(classes.T), root(share[:, 128:].sum(1)), entropy, *np.log1p(more[:, :3].T), root(more[:, 3]), np.log1p(more[:, 4]), root(more[:, 5]), root(more[:, 6]), root(more[:, 7])]
    return np.stack(out, 1)


@dataclass(frozen=True)
class Model:
    """Per class: mean, inverse Cholesky factor, log determinant, log share."""

    mean: np.ndarray
    whiten: np.ndarray
    log_det: np.ndarray
    log_share: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1; 0.5 for all where a class has too few rows."""
        if not len(self.mean):
            return np.full(len(x), 0.5)
        log = [s - 0.5 * (d + (((x - m) @ w.T) ** 2).sum(1)) for m, w, d, s in zip(self.mean, self.whiten, self.log_det, self.log_share)]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def fit(n: np.ndarray, s: np.ndarray, ss: np.ndarray, pooled: float = 0.3, diagonal: float = 0.1) -> Model:
    """From counts (2), sums (2, D) and sums of products (2, D, D) of the classes. A class of fewer than two rows gives no model."""
    if (n < 2).any():
        return Model(*(np.empty(0) for _ in range(4)))
    mean = s / n[:, None]
    cov = ss / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
    whole = (cov * n[:, None, None]).sum(0) / n.sum()
    scale = np.diag(np.maximum(np.diag(whole), 1e-6))
    whiten, log_det = [], []
    for c in cov:
        c = (1 - pooled) * c + pooled * whole
        c = (1 - diagonal) * c + diagonal * np.diag(np.diag(c)) + 1e-3 * scale
        factor = np.linalg.cholesky(c)
        whiten.append(np.linalg.inv(factor))
        log_det.append(2 * np.log(np.diag(factor)).sum())
    return Model(mean, np.stack(whiten), np.array(log_det), np.log(n / n.sum()))


def held_out(key: Column) -> Column:
    """Rows that no label is learnt from: crc32 of the key as text is 2 modulo 4."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _texts(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, list[str]]]:
    """Texts a few MB at a time, with the place of the first."""
    took, size, at = [], 0, 0
    for i, t in enumerate(batch[column]):
        took.append(t.as_py() or "")
        size += len(took[-1])
        if size > 4 << 20:
            yield at, took
            took, size, at = [], 0, i + 1
    if took:
        yield at, took


def add_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """All columns but the text, and `statistics` array<double>. Another column so named is replaced."""
    keep = df.drop("statistics")
    slim = keep.drop(text)
    names, schema = slim.columns, slim.schema.add("statistics", T.ArrayType(T.DoubleType()))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.concatenate([statistics(t) for _, t in _texts(batch, text)])
                made = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * D, pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), made], names=[*names, "statistics"])

    return keep.withColumn(text, keep[text].cast("string")).mapInArrow(tidy(run), schema)


def train(rows: DataFrame, **shrink: float) -> Model:
    """From rows of `statistics` and `quality` 0 or 1; rows of other labels or none are left out.

    Each task sums its rows; one sum for each class and entry comes to the driver, 2 * (1 + D + D * D) numbers.
    """

    def moments(batches):
        n, s, ss = np.zeros(2), np.zeros((2, D)), np.zeros((2, D, D))
        for batch in batches:
            x = batch["statistics"].flatten().to_numpy(zero_copy_only=False).reshape(-1, D)
            y = batch["quality"].to_numpy(zero_copy_only=False)
            for c in (0, 1):
                own = x[y == c]
                n[c] += len(own)
                s[c] += own.sum(0)
                ss[c] += own.T @ own
        flat = np.concatenate([n, s.ravel(), ss.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], names=["at", "sum"])

    known = rows.filter(rows["quality"].isin(0, 1)).select("statistics", rows["quality"].cast("int").alias("quality"))
    got = known.mapInArrow(tidy(moments), "at int, sum double").groupBy("at").agg(F.sum("sum").alias("sum")).collect()
    flat = np.zeros(2 * (1 + D + D * D))
    for r in got:
        flat[r["at"]] = r["sum"]
    return fit(flat[:2], flat[2 : 2 + 2 * D].reshape(2, D), flat[2 + 2 * D :].reshape(2, D, D), **shrink)


def score(rows: DataFrame, model: Model) -> DataFrame:
    """Rows of `statistics` with `score` in their place."""
    rest = rows.drop("statistics", "score")
    names, schema = rest.columns, rest.schema.add("score", "double")

    def run(batches):
        for batch in batches:
            x = batch["statistics"].flatten().to_numpy(zero_copy_only=False).reshape(-1, D)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(model.score(x))], names=[*names, "score"])

    return rows.select(*names, "statistics").mapInArrow(tidy(run), schema)


def one_label(labels: DataFrame) -> DataFrame:
    """doc_id and quality, a row an id: of ids that are labelled twice the smaller label, of unknown ones none."""
    return labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, learnt from labelled rows that aren't held out.

    Texts are read once; their statistics are a written table. Nulls: a null text is empty, a null id is scored but
    never learnt from. Empty texts get the score of an empty vector of statistics. Repeated rows are scored each.
    Without two rows of each label all scores are 0.5. Extra columns are not read. Empty tables give empty tables.
    """
    stage = Stage(docs.sparkSession, "quality")
    slim = docs.select(docs["doc_id"], docs["text"])
    rows = stage.write(add_statistics(slim), "statistics")
    known = rows.filter(~held_out(F.col("doc_id"))).join(one_label(labels), "doc_id")
    out = score(rows, train(known))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of `docs`, all columns as they are, whose score reaches the threshold; nulls as in `classify`."""
    stage = Stage(docs.sparkSession, "quality")
    # of rows that may be learnt from; texts are not shuffled
    slim = stage.write(add_statistics(docs.select("doc_id", "text").filter(~held_out(F.col("doc_id")))), "statistics")
    model = train(slim.join(one_label(labels), "doc_id"))
    stage.drop("statistics")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                good = np.concatenate([model.score(statistics(t)) for _, t in _texts(batch, "text")]) >= threshold
                yield batch.filter(pa.array(good))

    return docs.mapInArrow(tidy(run), docs.schema)
