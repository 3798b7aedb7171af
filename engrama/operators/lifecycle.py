"""Lifecycle: expiry, batches of old memories, extractive summaries, consolidated records."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import tokens_of
from ..schema import BATCH_MAX, BATCH_MIN, CONSOLIDATE_AFTER_S, SUMMARY_BYTES, SUMMARY_TAGS


def expired(live: DataFrame, now: int) -> DataFrame:
    return live.filter(F.col("expires_at") <= now)


def candidates(live: DataFrame, now: int, after_s: int = CONSOLIDATE_AFTER_S) -> DataFrame:
    """Episodic rows that are old enough and not expired."""
    return live.filter((F.col("kind") == "episodic") & (F.col("created_at") <= now - after_s * 1000) & (F.col("expires_at").isNull() | (F.col("expires_at") > now)))


#: Slices of time that a group's rows are ranked in apart: rows without a session may be most of a collection.
SLICE_MS = 86_400_000


def batches(rows: DataFrame, least: int = BATCH_MIN, most: int = BATCH_MAX, by: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """``rows`` with ``batch`` and ``place`` in it, oldest first; a group's last batch goes if it is short.

    ``by=("session_id", "agent_id")`` never mixes private rows of several agents. A group is ranked day by day: what its rows pass through is
    one task a day, and a row per day says how many came before.
    """
    sliced = rows.withColumn("__slice", F.floor(F.col("created_at") / SLICE_MS))
    days = sliced.groupBy(*by, "__slice").agg(F.count(F.lit(1)).alias("__in"))
    days = days.withColumn("__before", F.sum("__in").over(W.partitionBy(*by).orderBy("__slice")) - F.col("__in")).withColumn("__all", F.sum("__in").over(W.partitionBy(*by)))
    names = [f"__d_{b}" for b in (*by, "slice")]
    days = days.select(*[F.col(c).alias(n) for c, n in zip((*by, "__slice"), names, strict=True)], "__before", "__all")
    same = F.col("__slice").eqNullSafe(F.col(names[-1]))
    for b, n in zip(by, names, strict=False):
        same &= F.col(b).eqNullSafe(F.col(n))
    inside = F.row_number().over(W.partitionBy(*by, "__slice").orderBy("created_at", "id")) - 1
    placed = sliced.withColumn("__n", inside).join(days, same).withColumn("__n", F.col("__n") + F.col("__before")).drop("__slice", "__before", *names)
    placed = placed.withColumn("batch", F.floor(F.col("__n") / most).cast("int")).withColumn("place", (F.col("__n") % most).cast("int"))
    size = F.least(F.lit(most), F.col("__all") - F.col("batch") * most)
    return placed.filter(size >= least).drop("__n", "__all")


def centrality(tokens: list[list[str]]) -> list[float]:
    """How much of a batch each memory's tokens stand for: the number of memories that hold each of them, summed, over its length."""
    df: dict[str, int] = {}
    for distinct in map(set, tokens):
        for t in distinct:
            df[t] = df.get(t, 0) + 1
    return [sum(df[t] for t in set(ts)) / (len(ts) + 3.0) for ts in tokens]


def central(batched: DataFrame) -> DataFrame:
    """``batched`` with ``score``, its ``centrality`` within its batch of at most ``most`` rows."""

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(score=centrality([tokens_of(t) for t in pdf["text"]]))

    by = [c for c in ("session_id", "agent_id") if c in batched.columns]
    names = [*by, "batch", "place", "text"]
    types = {f.name: f.dataType.simpleString() for f in batched.schema}
    return batched.select(*names).groupBy("session_id", "batch").applyInPandas(score, ", ".join(f"{n} {types[n]}" for n in names) + ", score double")


def summarize(memories: list[str], most: int = SUMMARY_BYTES) -> str:
    """The most central memories that fit a budget of bytes, in their order. The best one is taken whatever its size."""
    if not memories:
        raise ValueError("nothing to summarize")
    tokens = [tokens_of(m) for m in memories]
    scores = centrality(tokens)
    taken, used = [], 0
    for i in sorted(range(len(memories)), key=lambda i: -scores[i]):
        size = len(memories[i].encode())
        if taken and used + size > most:
            continue
        taken.append(i)
        used += size + 2
        if used >= most:
            break
    return "; ".join(memories[i].rstrip(".;") for i in sorted(taken))


def summaries(batched: DataFrame, by: tuple[str, ...] = ("session_id",), summarizer: Callable[[list[str]], str] = summarize) -> DataFrame:
    """(by, batch, text): one grouped call per batch of at most ``most`` rows."""
    types = {f.name: f.dataType.simpleString() for f in batched.schema}

    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        return pd.DataFrame([{**{b: pdf[b].iloc[0] for b in by}, "batch": pdf["batch"].iloc[0], "text": summarizer(pdf["text"].tolist())}])

    schema = ", ".join(f"{b} {types[b]}" for b in by) + ", batch int, text string"
    return batched.groupBy(*by, "batch").applyInPandas(apply, schema)


def consolidated(batched: DataFrame, now: int, by: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """What a summary record takes from its batch, without the text."""
    ordered = F.array_sort(F.collect_list(F.struct("place", "id", "agent_id", "tags", "visibility")))
    out = batched.groupBy(*by, "batch").agg(
        F.max("importance").alias("importance"), F.count(F.lit(1)).alias("count"), F.min("created_at").alias("from_ms"), F.max("created_at").alias("to_ms"),
        F.bool_and(F.col("visibility") == "shared").alias("__shared"), ordered.alias("__rows"),
    )
    return out.select(
        *[b for b in by if b != "agent_id"], "batch", F.lit("semantic").alias("kind"), F.lit(now).alias("created_at"), "importance",
        F.transform("__rows", lambda r: r["id"]).alias("sources"), F.get("__rows", F.lit(0))["agent_id"].alias("agent_id"),
        F.slice(F.array_distinct(F.flatten(F.transform("__rows", lambda r: r["tags"]))), 1, SUMMARY_TAGS).alias("tags"),
        F.when(F.col("__shared"), "shared").otherwise("private").alias("visibility"), "count", "from_ms", "to_ms",
    )
