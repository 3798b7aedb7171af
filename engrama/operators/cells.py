"""An index of vectors by cells: partitioned by the nearest of k-means centroids, optionally with 8-bit codes.

A search reads the folders of its queries' ``n_probe`` nearest cells and scores them in Arrow batches. Where no cell may be missed
(``bounded``), it then reads every other cell, unless the cone and the longest vector of that cell rule it out.
Where there are codes, the scan reads these alone, and the best candidates are scored again by their exact vectors.
The cells hold the vectors of the most frequent length. Those of other lengths are kept beside them and searched exactly, each by the
queries of its length.

Writes are numbered: ``append`` adds rows to the cells of the first write, ``remove`` hides what was written before it. A write shows
with its row in ``commits``, its last step; what a failed one left is overwritten by the next. To replace a row, remove and append it.
The centroids stay those of the first write: where the data move, write the index anew. Vectors of cells are kept as 32-bit floats: scores
that differ by less may change places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as vx
from ..functions.vectors import LEAST_STEP
from ..schema import SQ8_FROM_DIM
from .knn import CONSTRAINTS, FILTERED_BY, assign, best_rows, centroids, constraints_of, eligible, in_blocks, knn
from .ranking import top_k

MODES = ("auto", "always", "never")
#: Candidates that a block of queries may take to their exact vectors: these are broadcast.
MOST_CANDIDATES = 10**6
CARRIED = "kind string, tags array<string>, session_id string, agent_id string, created_at bigint, expires_at bigint, visibility string"


def quantizes(mode: str, dim: int) -> bool:
    """Whether vectors of ``dim`` are kept as 8-bit codes."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    return mode == "always" or mode == "auto" and dim >= SQ8_FROM_DIM


@F.pandas_udf(T.StructType([T.StructField("low", T.DoubleType()), T.StructField("delta", T.DoubleType()), T.StructField("codes", T.BinaryType())]))
def _encode(v: pd.Series) -> pd.DataFrame:
    """8-bit codes as in ``sq8_encode``, packed."""
    m = np.vstack(v.to_numpy()).astype(float)
    low = m.min(axis=1)
    delta = np.maximum((m.max(axis=1) - low) / 255.0, LEAST_STEP)
    codes = np.clip(np.floor((m - low[:, None]) / delta[:, None] + 0.5), 0, 255).astype(np.uint8)
    return pd.DataFrame({"low": low, "delta": delta, "codes": [c.tobytes() for c in codes]})


def _decoded(pdf: pd.DataFrame, dim: int) -> np.ndarray:
    """The vectors of stored rows, as a search scores them."""
    if "codes" not in pdf:
        return np.vstack(pdf["exact"].to_numpy()).astype(float)
    codes = np.frombuffer(b"".join(pdf["codes"]), np.uint8).reshape(len(pdf), dim)
    return pdf["low"].to_numpy()[:, None] + pdf["delta"].to_numpy()[:, None] * codes


def _extents(stored: DataFrame, centers: np.ndarray) -> dict[int, tuple[float, float]]:
    """Of each cell with rows: the widest angle of a vector to the centre, and the longest vector."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for cell, some in pdf.groupby("cell"):
                m = _decoded(some, centers.shape[1])
                norms = np.linalg.norm(m, axis=1)
                near = np.clip(m @ centers[int(cell)] / np.maximum(norms, 1e-300), -1, 1)
                yield pd.DataFrame({"cell": [int(cell)], "angle": [float(np.arccos(near[norms > 0]).max(initial=0.0))], "norm": [float(norms.max())]})

    found = stored.mapInPandas(run, "cell int, angle double, norm double").groupBy("cell").agg(F.max("angle").alias("angle"), F.max("norm").alias("norm"))
    return {r["cell"]: (r["angle"], r["norm"]) for r in found.collect()}  # as many as cells


def _commits(spark: SparkSession, path: str) -> list:
    """The writes so far, as many rows as there were."""
    return spark.read.schema("gen int, dim int, coded boolean, kind string, filtered boolean, removal boolean").parquet(f"{path}/commits").orderBy("gen").collect()


def _commit(spark: SparkSession, path: str, gen: int, about: tuple) -> None:
    rows = spark.createDataFrame([about], "dim int, coded boolean, kind string, filtered boolean, removal boolean")
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/gen={gen}")


def _put(rows: DataFrame, path: str, gen: int, centers: np.ndarray, dim: int, coded: bool, filtered: bool, key: str, vector: str) -> None:
    """Vectors of one write to their cells, those of other lengths beside them, and how far they reach."""
    spark = rows.sparkSession
    carried = list(FILTERED_BY) if filtered else []
    some = rows.filter(F.col(vector).isNotNull())
    some.filter(F.size(vector) != dim).select(key, F.col(vector).cast("array<double>").alias("embedding"), *carried).write.mode("overwrite").parquet(f"{path}/rest/gen={gen}")
    fitting = some.filter(F.size(vector) == dim).select(key, F.col(vector).cast("array<double>").alias(vector), *carried)
    placed = assign(fitting, centers, vector)
    columns = [key, "cell", *carried, F.col(vector).cast("array<float>").alias("exact")]
    if coded:
        placed = placed.withColumn("__q", _encode(F.col(vector)))
        columns += ["__q.low", "__q.delta", "__q.codes"]
    # a crowded cell is dealt out by key too
    dealt = placed.select(*columns).repartition("cell", F.pmod(F.xxhash64(key), F.lit(8)))
    dealt.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors/gen={gen}")
    kind = rows.schema[key].dataType.simpleString()
    written = _vectors(spark, path, key, kind, coded, filtered).filter(F.col("gen") == gen)
    extents = _extents(written.select("cell", *(["low", "delta", "codes"] if coded else ["exact"])), centers) if dim else {}
    reach = [(c, *e) for c, e in sorted(extents.items())]
    spark.createDataFrame(reach, "cell int, angle double, norm double").coalesce(1).write.mode("overwrite").parquet(f"{path}/extents/gen={gen}")


def _vectors(spark: SparkSession, path: str, key: str, kind: str, coded: bool, filtered: bool) -> DataFrame:
    parts = [f"`{key}` {kind}", "exact array<float>", *(["low double, delta double, codes binary"] if coded else []), *([CARRIED] if filtered else []), "gen int", "cell int"]
    return spark.read.schema(", ".join(parts)).parquet(f"{path}/vectors")


def write_index(corpus: DataFrame, path: str, cells: int = 64, mode: str = "auto", key: str = "id", vector: str = "embedding", seed: int = 1, filtered: bool = False) -> None:
    """``cells``: a bounded number of centroids, learned from 64 rows each. ``filtered``: keep the columns that constraints look at."""
    spark = corpus.sparkSession
    some = corpus.filter(F.col(vector).isNotNull())
    most = some.groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    dim = most["n"] if most else 0
    fitting = some.filter(F.size(vector) == dim).select(F.col(vector).cast("array<double>").alias(vector))
    centers = centroids(fitting, cells, vector, seed) if dim else np.zeros((0, 0))
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "cell int, center array<double>").coalesce(1).write.parquet(f"{path}/centers")
    coded = quantizes(mode, dim)
    _put(corpus, path, 0, centers, dim, coded, filtered, key, vector)
    _commit(spark, path, 0, (dim, coded, corpus.schema[key].dataType.simpleString(), filtered, False))


def append(rows: DataFrame, path: str, key: str = "id", vector: str = "embedding") -> None:
    """Add rows: one shuffle of these, none of what is there."""
    spark = rows.sparkSession
    last = _commits(spark, path)[-1]
    _put(rows, path, last["gen"] + 1, _centers(spark, path), last["dim"], last["coded"], last["filtered"], key, vector)
    _commit(spark, path, last["gen"] + 1, (last["dim"], last["coded"], last["kind"], last["filtered"], False))


def remove(keys: DataFrame, path: str, key: str = "id") -> None:
    """Hide the rows of these keys that were written so far. Keys that are not there are no error."""
    spark = keys.sparkSession
    last = _commits(spark, path)[-1]
    keys.select(F.col(key).cast(last["kind"]).alias(key)).distinct().write.mode("overwrite").parquet(f"{path}/gone/gen={last['gen'] + 1}")
    _commit(spark, path, last["gen"] + 1, (last["dim"], last["coded"], last["kind"], last["filtered"], True))


def _centers(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.schema("cell int, center array<double>").parquet(f"{path}/centers").orderBy("cell").collect()  # as many as cells
    return np.array([r["center"] for r in rows]) if rows else np.zeros((0, 0))


def search(queries: DataFrame, path: str, k: int, n_probe: int = 8, key: str = "id", block: int = 4096, bounded: bool = False, filtered: bool = False, now: int | None = None, rerank: int = 4, without: DataFrame | None = None) -> DataFrame:
    """(qid, id, score, rank) within the nearest cells of each query (qid, query_embedding and, if ``filtered``, constraints).

    ``bounded``: a first scan of these gives each query its k-th score (as many numbers as a block has queries); every cell that may
    hold a better one is then searched too, so that nothing is missed but what 8-bit codes round. A search with constraints or ``now``
    is always bounded: the nearest cells may hold no row that meets them.
    ``rerank``: with codes, so many times k candidates are scored by their exact vectors; 0 leaves the scores of the codes.
    ``without``: keys to leave out, whenever they were written.

    Queries are a stated set, taken in blocks of ``block``, or fewer where their candidates would pass ``MOST_CANDIDATES``. Only folders
    of cells that a block probes are read; each Arrow batch is multiplied with the queries that probe its cells.
    """
    spark = queries.sparkSession
    commits = _commits(spark, path)
    first, last = commits[0], commits[-1]["gen"]
    dim, coded, kind = first["dim"], first["coded"], first["kind"]
    filtering = filtered or now is not None
    if filtering and not first["filtered"]:
        raise ValueError("the index was written without the columns of constraints")
    centers = _centers(spark, path)
    reach = spark.read.schema("gen int, cell int, angle double, norm double").parquet(f"{path}/extents").filter(F.col("gen") <= last)
    reach = {r["cell"]: r for r in reach.groupBy("cell").agg(F.max("angle").alias("angle"), F.max("norm").alias("norm")).collect()}
    angles = np.array([reach[c]["angle"] if c in reach else 0.0 for c in range(len(centers))])
    norms_of_cells = np.array([reach[c]["norm"] if c in reach else 0.0 for c in range(len(centers))])
    gone = [c["gen"] for c in commits if c["removal"]]

    def there(rows: DataFrame) -> DataFrame:
        """Rows of committed writes that none after them removed."""
        rows = rows.filter(F.col("gen") <= last)
        if gone:
            removed = spark.read.schema(f"`{key}` {kind}, gen int").parquet(f"{path}/gone").filter(F.col("gen") <= last).groupBy(key).agg(F.max("gen").alias("__until"))
            rows = rows.alias("v").join(removed.alias("g"), (F.col(f"v.{key}") == F.col(f"g.{key}")) & (F.col("v.gen") < F.col("g.__until")), "left_anti")
        return rows if without is None else rows.join(without.select(key).distinct(), key, "left_anti")

    carried = list(FILTERED_BY) if first["filtered"] else []
    every = _vectors(spark, path, key, kind, coded, first["filtered"])
    wide = max(k * rerank, k) if coded and rerank else k
    if coded and rerank:
        block = max(1, min(block, MOST_CANDIDATES // wide))

    def nearest_cells(matrix: np.ndarray) -> np.ndarray:
        probed = np.zeros((len(matrix), len(centers)), bool)
        np.put_along_axis(probed, np.argsort(-(matrix @ centers.T), axis=1, kind="stable")[:, :n_probe], True, axis=1)
        return probed

    def not_ruled_out(part: list, matrix: np.ndarray, probed: np.ndarray) -> np.ndarray:
        """Cells whose bound reaches the k-th score found in those probed."""
        found = top_k(scan(part, matrix, probed, k), "score", k, key=key).groupBy("qid").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
        least = {r["qid"]: r["least"] for r in found.filter(F.col("n") >= k).collect()}
        norms = np.linalg.norm(matrix, axis=1)
        off = np.arccos(np.clip(matrix @ centers.T / np.maximum(norms, 1e-300)[:, None], -1, 1))
        most = norms[:, None] * norms_of_cells
        bound = most * np.maximum(np.cos(np.maximum(off - angles, 0.0)), 0.0)
        return probed | (bound + 1e-6 * (1 + most) >= np.array([least.get(r["qid"], -np.inf) for r in part])[:, None])

    def scan(part: list, matrix: np.ndarray, probed: np.ndarray, most: int) -> DataFrame:
        read_cells = np.flatnonzero(probed.any(axis=0))
        constraints = [{n: r.get(n) for n in CONSTRAINTS} for r in part] if filtering else []
        shared = spark.sparkContext.broadcast((np.array([r["qid"] for r in part]), matrix, {int(c): np.flatnonzero(probed[:, c]) for c in read_cells}, constraints))

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            qids, asked, probing, wanted = shared.value
            for pdf in batches:
                for cell, some in pdf.groupby("cell"):
                    some = some.reset_index(drop=True)
                    which = probing[int(cell)]
                    q = asked[which]
                    if coded:
                        c = np.frombuffer(b"".join(some["codes"]), np.uint8).reshape(len(some), dim).astype(float)
                        scores = some["low"].to_numpy()[:, None] * q.sum(axis=1)[None, :] + some["delta"].to_numpy()[:, None] * (c @ q.T)
                    else:
                        scores = np.vstack(some["exact"].to_numpy()).astype(float) @ q.T
                    ids = some[key].to_numpy()
                    place = np.empty(len(ids), int)
                    place[np.argsort(ids, kind="stable")] = np.arange(len(ids))
                    masks: dict[tuple, np.ndarray] = {}  # requests of equal constraints share one
                    best = []
                    for j, i in enumerate(which):
                        usable = None
                        if filtering:
                            same = constraints_of(wanted[i])
                            if same not in masks:
                                masks[same] = np.flatnonzero(eligible(wanted[i], some, now))
                            usable = masks[same]
                        best.append(best_rows(scores[:, j], place, most, usable))
                    sizes = [len(b) for b in best]
                    if sum(sizes):
                        at = np.concatenate(best)
                        yield pd.DataFrame({"qid": np.repeat(qids[which], sizes), key: ids[at], "cell": int(cell), "score": scores[at, np.repeat(np.arange(len(which)), sizes)]})

        columns = [key, "cell", *(["low", "delta", "codes"] if coded else ["exact"]), *(carried if filtering else [])]
        read = there(every.filter(F.col("cell").isin(*map(int, read_cells)))) if len(part) else every.limit(0)
        return read.select(*columns).mapInPandas(score, f"qid bigint, `{key}` {kind}, cell int, score double")

    def exactly(part: list, found: DataFrame, probed: np.ndarray) -> DataFrame:
        """The candidates of a block, scored by their vectors; at most ``MOST_CANDIDATES`` are broadcast, so the vectors are not shuffled."""
        asked = spark.createDataFrame([(r["qid"], r["query_embedding"].tolist()) for r in part], "qid bigint, __asked array<double>")
        found = found.select("qid", key, "cell").distinct()
        rows = there(every.filter(F.col("cell").isin(*map(int, np.flatnonzero(probed.any(axis=0)))))).select(key, "cell", "exact")
        rows = rows.join(F.broadcast(found), [key, "cell"]).join(F.broadcast(asked), "qid")
        return rows.select("qid", key, vx.dot(F.col("__asked"), F.col("exact")).alias("score"))

    out = None
    names = ["qid", "query_embedding", *(CONSTRAINTS if filtered else ())]
    for part in in_blocks(queries.filter(F.size("query_embedding") == dim).select(*names), block):
        matrix = np.array([r["query_embedding"] for r in part], float).reshape(len(part), dim)
        probed = nearest_cells(matrix)
        if (bounded or filtering) and len(part):
            probed = not_ruled_out(part, matrix, probed)
        scanned = scan(part, matrix, probed, wide)
        if coded and rerank and len(part):
            scanned = exactly(part, top_k(scanned, "score", wide, key=key), probed)
        scanned = scanned.select("qid", key, "score")
        out = scanned if out is None else out.unionByName(scanned)
    found = top_k(out, "score", k, key=key)
    beside = f"`{key}` {kind}, embedding array<double>, gen int" + (f", {CARRIED}" if first["filtered"] else "")
    rest = there(spark.read.schema(beside).parquet(f"{path}/rest"))
    others = queries.filter(F.size("query_embedding") != dim)
    if others.isEmpty() or rest.isEmpty():
        return found
    return found.unionByName(knn(others, rest, k, key=key, now=now, filtered=filtered, block=block).select(*found.columns))
