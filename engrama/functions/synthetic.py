"""Seeded vectors for benchmarks: uniform ones, and clusters of jittered centres."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def vectors(spark: SparkSession, n: int, dim: int, clustered: bool = True, noise: float = 0.15, seed: int = 42, first: int = 0, parts: int | None = None) -> DataFrame:
    """(id, embedding) of ``n`` unit vectors; a row depends on its id and the seed alone. There are n/100 centres, 10 at least."""
    k = max(10, n // 100)
    centers = np.random.default_rng(seed).uniform(-1, 1, (k, dim)) if clustered else None

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def make(ids: pd.Series) -> pd.Series:
        out = []
        for i in ids:
            rng = np.random.default_rng((seed, int(i)))
            v = rng.uniform(-1, 1, dim)
            v = v if centers is None else centers[int(i) % k] + noise * v
            out.append((v / np.linalg.norm(v)).astype("float32"))
        return pd.Series(out)

    return spark.range(first, first + n, numPartitions=parts).withColumn("embedding", make("id"))
