"""Top-k per group and rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import HALF_LIFE_MS, IMPORTANCE_WEIGHT, RRF_K


def ranked(df: DataFrame, score: str, by: str = "qid", key: str = "id", ascending: bool = False) -> DataFrame:
    """``rank`` from 1; equal scores (to 9 digits) in the order of the key."""
    value = F.round(score, 9)
    return df.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(value.asc() if ascending else value.desc(), key)))


def top_k(df: DataFrame, score: str, k: int | Column, by: str = "qid", key: str = "id", ascending: bool = False) -> DataFrame:
    return ranked(df, score, by, key, ascending).filter(F.col("rank") <= k)


def reciprocal(rank: Column) -> Column:
    """Contribution of a rank that counts from 1."""
    return F.lit(1.0) / (F.lit(RRF_K) + rank)


def fuse(legs: dict[str, DataFrame]) -> DataFrame:
    """(qid, id, a column per leg) from legs (qid, id, rank): one aggregation over their union, 0 where a leg lacks the row."""
    union = None
    for name in legs:
        one = legs[name].select("qid", "id", *[(reciprocal(F.col("rank")) if n == name else F.lit(0.0)).alias(n) for n in legs])
        union = one if union is None else union.unionByName(one)
    return union.groupBy("qid", "id").agg(*[F.max(n).alias(n) for n in legs])


def recency(created_at: Column, now: int | Column) -> Column:
    """Exponential decay with a half-life of a week, in (0, 1]."""
    now = F.lit(now) if isinstance(now, int) else now
    age = F.greatest(now - created_at, F.lit(0))
    return F.exp(-age * F.log(F.lit(2.0)) / F.lit(float(HALF_LIFE_MS)))


def importance_signal(importance: Column) -> Column:
    return importance * IMPORTANCE_WEIGHT
