"""Statistics, histograms and quality metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import SQ8_FROM_DIM

#: Upper edges of the latency histogram, in seconds.
EDGES = (0.0005, 0.001, 0.0025, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 5.0)


def stats(live: DataFrame, tail_ops: Column | int = 0) -> DataFrame:
    """One row of counts, from one pass; distinct entities from a second."""
    entities = live.select(F.explode("entities").alias("e")).agg(F.count_distinct("e").alias("entities"))
    counts = live.agg(F.count(F.lit(1)).alias("total_memories"), F.count("embedding").alias("vector_indexed"), F.count("text").alias("lexical_indexed"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("vector_dim"))
    tail = F.lit(tail_ops) if isinstance(tail_ops, int) else tail_ops
    return counts.withColumn("entities", entities.scalar()).select("*", (F.col("vector_dim") >= SQ8_FROM_DIM).alias("quantized"), tail.cast("long").alias("wal_tail_ops"))


def latency_histogram(rows: DataFrame, seconds: Column, by: str, edges: tuple[float, ...] = EDGES) -> DataFrame:
    """(by, le, count) cumulative, with +Inf, and sum and total per group."""
    s = rows.select(by, seconds.alias("s"))
    agg = s.groupBy(by).agg(*[F.count(F.when(F.col("s") <= e, 1)).alias(f"__{i}") for i, e in enumerate(edges)], F.count("s").alias("total"), F.sum("s").alias("sum_seconds"))
    buckets = F.array(*[F.struct(F.lit(str(e)).alias("le"), F.col(f"__{i}").alias("cnt")) for i, e in enumerate(edges)], F.struct(F.lit("+Inf").alias("le"), F.col("total").alias("cnt")))
    return agg.select(by, F.inline(buckets), "total", "sum_seconds")


def request_counts(rows: DataFrame, route: str, status: str) -> DataFrame:
    return rows.groupBy(route, status).agg(F.count(F.lit(1)).alias("cnt")).withColumn("rejected", F.col(status).isin(401, 403))


def percentiles(rows: DataFrame, value: str, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.percentile(value, 0.5).alias("p50"), F.percentile(value, 0.95).alias("p95"))


def verdicts(rows: DataFrame, verdict: str, by: str) -> DataFrame:
    """Shares of Correct, Hallucination and Omission among valid verdicts, per group."""
    valid = rows.filter(F.col(verdict).isin("Correct", "Hallucination", "Omission"))
    share = lambda v: F.round(F.avg(F.when(F.col(verdict) == v, 1.0).otherwise(0.0)), 4)
    return valid.groupBy(by).agg(F.count(F.lit(1)).alias("n"), share("Correct").alias("correct"), share("Hallucination").alias("hallucination"), share("Omission").alias("omission"))


def recall_at_k(found: DataFrame, truth: DataFrame, key: str = "id") -> DataFrame:
    """One row: share of the true neighbours that were found."""
    hits = truth.join(found.select("qid", key), ["qid", key], "left_semi").agg(F.count(F.lit(1)).alias("hits"))
    total = truth.agg(F.count(F.lit(1)).alias("total")).withColumn("hits", hits.scalar())
    return total.select("hits", "total", F.try_divide("hits", "total").alias("recall"))


def hit_at_k(found: DataFrame, answers: DataFrame, k: int, key: str = "id") -> DataFrame:
    """Per kind of probe: share of probes whose answer is among the first k. ``answers``: qid, id, probe."""
    hit = answers.join(found.filter(F.col("rank") <= k).select("qid", key, F.lit(1).alias("__hit")), ["qid", key], "left")
    return hit.groupBy("probe").agg(F.count_distinct("qid").alias("n"), (F.count_distinct(F.when(F.col("__hit") == 1, F.col("qid"))) / F.count_distinct("qid")).alias("hit_rate"))
