"""Nearest vectors of a set of queries.

``knn`` is exact: the stated queries, in blocks of ``block``, are multiplied with each Arrow batch of the corpus, each batch
gives at most k rows a query, and one window ranks these. The corpus is scanned once a block and never shuffled; what is
shuffled is k rows per query and batch. ``cells`` has the index that scans only the cells of the nearest centroids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import top_k

#: Constraints of a request that the vector leg applies before it scores.
CONSTRAINTS = ("kinds", "tags", "session_id", "agent_id", "since", "until", "as_agent")
#: Columns of a memory that constraints look at.
FILTERED_BY = ("kind", "tags", "session_id", "agent_id", "created_at", "expires_at", "visibility")


def eligible(request: dict, pdf: pd.DataFrame, now: int | None) -> np.ndarray:
    """The rows of a batch that meet a request."""
    ok = np.ones(len(pdf), bool)
    if now is not None:
        ok &= pdf["expires_at"].isna().to_numpy() | (pdf["expires_at"] > now).to_numpy()
    if request.get("kinds") is not None and len(request["kinds"]):
        ok &= pdf["kind"].isin(request["kinds"]).to_numpy()
    if request.get("tags") is not None and len(request["tags"]):
        wanted = set(request["tags"])
        ok &= np.fromiter((t is not None and wanted.issubset(t) for t in pdf["tags"]), bool, len(pdf))
    for name in ("session_id", "agent_id"):
        if request.get(name) is not None:
            ok &= (pdf[name] == request[name]).to_numpy()
    if request.get("since") is not None:
        ok &= (pdf["created_at"] >= request["since"]).to_numpy()
    if request.get("until") is not None:
        ok &= (pdf["created_at"] <= request["until"]).to_numpy()
    if request.get("as_agent") is not None:
        ok &= (pdf["visibility"] == "shared").to_numpy() | pdf["agent_id"].isna().to_numpy() | (pdf["agent_id"] == request["as_agent"]).to_numpy()
    return ok


def blocks_of(queries: DataFrame, block: int) -> Iterator[list[dict]]:
    """A stated query set as lists of at most ``block`` rows; an empty one as one empty list. One block comes by Arrow, more one after the other."""
    first = queries.limit(block + 1).toArrow()
    if first.num_rows <= block:
        yield first.to_pylist()
        return
    part: list[dict] = []
    for r in queries.toLocalIterator():
        part.append(r.asDict())
        if len(part) == block:
            yield part
            part = []
    if part:
        yield part


def in_blocks(queries: DataFrame, block: int) -> Iterator[list[dict]]:
    """``blocks_of`` with vectors as arrays."""
    for part in blocks_of(queries, block):
        yield [r | {"query_embedding": np.asarray(r["query_embedding"], float)} for r in part]


def constraints_of(request: dict) -> tuple:
    return tuple(tuple(v) if isinstance(v, list) else v for v in map(request.get, CONSTRAINTS))


def best_rows(scores: np.ndarray, place: np.ndarray, k: int, usable: np.ndarray | None = None) -> np.ndarray:
    """The k rows of the largest scores (to 9 digits), equal ones in the order of ``place``; of ``usable`` rows only."""
    values = np.round(scores if usable is None else scores[usable], 9)
    near = np.arange(len(values))
    if len(values) > 4 * k:
        least = np.partition(values, len(values) - k)[len(values) - k]
        near = np.flatnonzero(values >= least)
    rows = near if usable is None else usable[near]
    return rows[np.lexsort((place[rows], -values[near]))[:k]]


def knn(queries: DataFrame, corpus: DataFrame, k: int, key: str = "id", vector: str = "embedding", now: int | None = None, filtered: bool = False, block: int = 4096) -> DataFrame:
    """(qid, id, score, rank): inner products, largest first. ``queries``: qid, query_embedding and, if ``filtered``, constraints.

    A query without a vector, or of another length than a row's, has no neighbours there.
    """
    spark = corpus.sparkSession
    names = ["qid", "query_embedding", *(CONSTRAINTS if filtered else ())]
    # read in blocks of `block` rows, so that a broadcast is bounded by that many vectors
    asked = queries.filter(F.col("query_embedding").isNotNull()).select(*names)
    kind = corpus.schema[key].dataType.simpleString()
    columns = [key, vector] + (list(FILTERED_BY) if filtered or now is not None else [])
    out = None

    def scan(part: list[dict]) -> DataFrame:
        shared = spark.sparkContext.broadcast(part)

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            requests = shared.value
            dims = np.array([len(r["query_embedding"]) for r in requests])
            qids = np.array([r["qid"] for r in requests])
            for pdf in batches:
                pdf = pdf[pdf[vector].notna()].reset_index(drop=True)
                sizes = pdf[vector].map(len).to_numpy() if len(pdf) else np.zeros(0, int)
                for dim in np.unique(sizes):
                    which = np.flatnonzero(dims == dim)
                    if not len(which):
                        continue
                    some = pdf[sizes == dim].reset_index(drop=True)
                    matrix = np.vstack(some[vector].to_numpy()).astype(float)
                    scores = matrix @ np.array([requests[i]["query_embedding"] for i in which], float).T
                    ids = some[key].to_numpy()
                    place = np.empty(len(ids), int)
                    place[np.argsort(ids, kind="stable")] = np.arange(len(ids))
                    masks: dict[tuple, np.ndarray] = {}  # requests of equal constraints share one
                    best = []
                    for j, i in enumerate(which):
                        usable = None
                        if filtered or now is not None:
                            same = constraints_of(requests[i])
                            if same not in masks:
                                masks[same] = np.flatnonzero(eligible(requests[i], some, now))
                            usable = masks[same]
                        best.append(best_rows(scores[:, j], place, k, usable))
                    counts = [len(b) for b in best]
                    if sum(counts):
                        at = np.concatenate(best)
                        yield pd.DataFrame({"qid": np.repeat(qids[which], counts), key: ids[at], "score": scores[at, np.repeat(np.arange(len(which)), counts)]})

        return corpus.select(*columns).mapInPandas(score, f"qid bigint, `{key}` {kind}, score double")

    for part in in_blocks(asked, block):
        out = scan(part) if out is None else out.unionByName(scan(part))
    return top_k(out, "score", k, key=key)


def centroids(corpus: DataFrame, n: int, vector: str = "embedding", seed: int = 1) -> np.ndarray:
    """Unit centroids of a bounded sample (64 rows a centroid) by k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    sample = corpus.select(vector).orderBy(F.xxhash64(vector)).limit(64 * n)
    model = KMeans(k=n, seed=seed, maxIter=8, featuresCol="__v").fit(sample.select(array_to_vector(F.col(vector).cast("array<double>")).alias("__v")))
    found = np.array(model.clusterCenters())
    return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)


def assign(corpus: DataFrame, centers: np.ndarray, vector: str = "embedding") -> DataFrame:
    """``corpus`` with ``cell``, the nearest centroid; write it partitioned by ``cell`` to make scans of few cells cheap."""

    @F.pandas_udf("int")
    def nearest(v: pd.Series) -> pd.Series:
        return pd.Series((np.vstack(v.to_numpy()).astype(float) @ centers.T).argmax(axis=1).astype("int32")) if len(v) else pd.Series([], dtype="int32")

    return corpus.withColumn("cell", nearest(F.col(vector)))
