"""Batch recall: three ranked legs, reciprocal-rank fusion, recency and importance, five strategies.

Requests are a DataFrame, so one job answers many. Legs carry ids only; records are joined to the fused candidates,
at most 300 a request. All legs score rows where they lie; filters hold before a leg is cut to its candidates.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import InheritableThread
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.embedding import DIM, hash_embed
from ..functions.entities import extract_entities
from ..operators import graph, knn, lexical
from ..operators.filters import request_matches
from ..operators.ranking import fuse, importance_signal, recency, top_k
from ..schema import CANDIDATES, RERANK_POOL, STRATEGIES, TOP_K

#: Defaults of a request's optional columns.
OPTIONAL = {"strategy": "string", "as_agent": "string", "kinds": "array<string>", "tags": "array<string>", "session_id": "string", "agent_id": "string", "since": "bigint", "until": "bigint", "top_k": "int", "query_embedding": "array<double>"}


def complete(requests: DataFrame, embedder: Callable[[Column], Column] | None = None) -> DataFrame:
    """Requests with all columns; queries without a vector are embedded."""
    for name, kind in OPTIONAL.items():
        if name not in requests.columns:
            requests = requests.withColumn(name, F.lit(None).cast(kind))
    embed = embedder or (lambda text: hash_embed(text, DIM))
    return requests.withColumns({
        "strategy": F.coalesce("strategy", F.lit("balanced")),
        "top_k": F.coalesce("top_k", F.lit(TOP_K)),
        "query_embedding": F.coalesce("query_embedding", embed(F.when(F.col("query_embedding").isNull(), F.coalesce("query", F.lit(""))))),
    })


def vector_leg(requests: DataFrame, memories: DataFrame, now: int, k: int = CANDIDATES) -> DataFrame:
    return knn.knn(requests, memories, k, now=now, filtered=True)


def lexical_leg(requests: DataFrame, memories: DataFrame, now: int, k: int = CANDIDATES) -> DataFrame:
    return lexical.bm25_topk(requests, memories, k, filtered=True, now=now)


def query_entities(requests: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    return requests.select("qid", F.explode(extract_entities(F.coalesce("query", F.lit("")), none)).alias("entity"))


def graph_leg(requests: DataFrame, memories: DataFrame, now: int, k: int = CANDIDATES, post_filter: bool = False) -> DataFrame:
    """``post_filter``: cut to the candidates first and filter then."""
    entities = query_entities(requests)
    if not post_filter:
        return graph.related_topk(entities, memories, k, requests, now=now)
    found = graph.related_topk(entities, memories, k).alias("x")
    m = memories.select("id", *knn.FILTERED_BY).alias("m")
    r = requests.select("qid", *knn.CONSTRAINTS).alias("r")
    joined = found.join(m, F.col("x.id") == F.col("m.id")).join(r, F.col("x.qid") == F.col("r.qid"))
    return joined.filter(request_matches("m", "r", now)).select("x.*")


def all_legs(requests: DataFrame, memories: DataFrame, now: int, vector: Callable | None = None) -> dict[str, DataFrame]:
    """The three legs. What each asks of the cluster before it can be planned (terms, statistics, neighbours) is asked at the same time."""
    found: dict[str, DataFrame | BaseException] = {}

    def make(name: str, leg: Callable) -> None:
        try:
            found[name] = leg(requests, memories, now)
        except BaseException as e:  # noqa: BLE001  raised again below
            found[name] = e

    legs = {"vector": vector or vector_leg, "lexical": lexical_leg, "graph": graph_leg}
    threads = [InheritableThread(target=make, args=x, session=memories.sparkSession) for x in legs.items()]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    for name in legs:
        if isinstance(found[name], BaseException):
            raise found[name]
    return {name: found[name] for name in legs}


def strategy_weights(strategy: Column) -> list[Column]:
    def pick(i: int) -> Column:
        out = F.lit(STRATEGIES["balanced"][i])
        for name, weights in STRATEGIES.items():
            out = F.when(strategy == name, weights[i]).otherwise(out)
        return out

    return [pick(i) for i in range(4)]


def recall(requests: DataFrame, memories: DataFrame, now: int, reranker: Callable[[str, list[str]], list[float]] | None = None, embedder: Callable[[Column], Column] | None = None, vector: Callable | None = None) -> DataFrame:
    """Hits: qid, rank, id, score and the signals vector, lexical, graph, recency, importance, rerank.

    ``memories`` need ``embedding`` and ``entities``. vector, lexical and graph are contributions before the strategy's weights.
    ``vector``: another leg of vectors, such as an index.
    """
    requests = complete(requests, embedder)
    legs = all_legs(requests, memories, now, vector)
    asked = requests.select("qid", "strategy", "top_k", "query")
    rows = fuse(legs).join(memories.select("id", "text", "created_at", F.col("importance").alias("__importance")), "id").join(asked, "qid")
    rows = rows.withColumn("recency", recency(F.col("created_at"), now)).withColumn("importance", importance_signal(F.col("__importance").cast("double")))
    v, l, g, r = strategy_weights(F.col("strategy"))
    score = v * F.col("vector") + l * F.col("lexical") + g * F.col("graph") + r * F.col("recency") / 60.0 + F.col("importance")
    rows = rows.withColumn("score", score)
    signals = ["vector", "lexical", "graph", "recency", "importance"]
    if reranker is None:
        return top_k(rows, "score", F.col("top_k")).select("qid", "rank", "id", "score", *signals, F.lit(0.0).alias("rerank"))
    pool = top_k(rows, "score", F.col("top_k") * RERANK_POOL)
    return rerank(pool, reranker, signals)


def rerank(pool: DataFrame, reranker: Callable[[str, list[str]], list[float]], signals: list[str]) -> DataFrame:
    """Order a pool by a scorer of (query, texts), then by score. A scorer that fails, or returns another number of scores, leaves the order."""
    names = ["qid", "rank", "id", "score", *signals, "rerank"]

    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        try:
            found = [float(x) for x in reranker(pdf["query"].iloc[0], pdf["text"].tolist())]
        except Exception:  # noqa: BLE001  a plugged-in scorer may fail in any way
            found = []
        if len(found) == len(pdf):
            pdf["rerank"] = found
            pdf = pdf.assign(__a=-pdf["rerank"], __b=-pdf["score"].round(9)).sort_values(["__a", "__b", "id"])
        else:
            pdf["rerank"] = 0.0
        pdf = pdf.head(int(pdf["top_k"].iloc[0]))
        pdf["rank"] = np.arange(1, len(pdf) + 1)
        return pdf[names]

    schema = "qid bigint, rank int, id string, score double, " + ", ".join(f"{s} double" for s in [*signals, "rerank"])
    return pool.groupBy("qid").applyInPandas(apply, schema)
