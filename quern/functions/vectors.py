"""A deterministic embedder for use without a model."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def hashed(dimension: int = 64):
    """A pandas UDF: words hashed to signed places, unit length; of a text without words a zero vector."""

    @F.pandas_udf("array<float>")
    def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            out = []
            for t in s:
                v = np.zeros(dimension, np.float32)
                for w in (t or "").lower().split():
                    h = zlib.crc32(w.encode())
                    v[h % dimension] += 1 if h >> 31 else -1
                n = np.linalg.norm(v)
                out.append((v / n if n else v).tolist())
            yield pd.Series(out)

    return embed
