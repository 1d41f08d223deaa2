"""Hashed feature vectors of words."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The FNV-1a parameters.
_BASIS, _PRIME = 0x811C9DC5, 0x01000193


def fnv1a(text: str) -> int:
    """32-bit FNV-1a over UTF-16 code units."""
    h = _BASIS
    for unit in np.frombuffer(text.encode("utf-16-le", "surrogatepass"), dtype="<u2").tolist():
        h = ((h ^ unit) * _PRIME) & 0xFFFFFFFF
    return h


def _vector(word: str) -> list[float]:
    marked, out = f"^{word}$", np.zeros(16)
    for size in (1, 2, 3):
        for at in range(len(marked) - size + 1):
            h = fnv1a(marked[at : at + size])
            out[h % 16] += (1.0 if h & 16 else -1.0) / size
    norm = float(np.sqrt((out**2).sum())) or 1.0
    return [float(x) for x in out / norm]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def char_vector(word: pd.Series) -> pd.Series:
    """Signed hashed character 1- to 3-grams of `^word$` in 16 dimensions, of length one; a null word has none."""
    return word.map(lambda w: None if w is None else _vector(w))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def hash_bins(words: pd.Series) -> pd.Series:
    """Context words in 12 hashed bins, 0.2 each."""

    def bins(ws) -> list[float] | None:
        if ws is None:
            return None
        return [float(x) for x in np.bincount([fnv1a(w) % 12 for w in ws] or [0], minlength=12) * (0.2 if len(ws) else 0.0)]

    return words.map(bins)
