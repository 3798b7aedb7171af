"""The offline embedder: signed feature hashing of words, word parts and word pairs."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import tokens_of

DIM = 256
WORD, TRIGRAM, PAIR = 1.0, 0.4, 0.7


@lru_cache(maxsize=200_000)
def _place(feature: str, dim: int) -> tuple[int, float]:
    """Bucket and sign; by MD5, so that any engine gives the same."""
    digest = hashlib.md5(feature.encode(), usedforsecurity=False).hexdigest()
    return int(digest[:8], 16) % dim, 1.0 if int(digest[8], 16) < 8 else -1.0


def features_of(text: str | None) -> list[tuple[str, float]]:
    tokens = tokens_of(text)
    out = [(t, WORD) for t in tokens]
    out += [("#" + t[i : i + 3], TRIGRAM) for t in tokens if len(t) > 3 for i in range(len(t) - 2)]
    return out + [(f"{a}_{b}", PAIR) for a, b in zip(tokens, tokens[1:], strict=False)]


def embed(text: str | None, dim: int = DIM) -> np.ndarray:
    """A unit vector; zero for a text without tokens."""
    v = np.zeros(dim)
    for feature, weight in features_of(text):
        at, sign = _place(feature, dim)
        v[at] += sign * weight
    n = np.sqrt(v @ v)
    return v / n if n > 0 else v


def hash_embed(text: Column, dim: int = DIM) -> Column:
    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else embed(t, dim) for t in texts])

    return run(text)
