"""Requests to remember: validation, defaults, ids, restoring."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.embedding import hash_embed
from ..functions.entities import extract_entities
from ..functions.vectors import normalize
from ..schema import LEAST_CREATED_MS, MEMORY, WORKING_TTL_S

REQUEST_COLUMNS = {"text": "string", "kind": "string", "tags": "array<string>", "session_id": "string", "agent_id": "string", "metadata": "string", "importance": "double", "ttl_seconds": "bigint", "visibility": "string", "embedding": "array<double>", "created_at": "bigint", "sources": "array<string>"}


def complete(requests: DataFrame) -> DataFrame:
    for name, kind in REQUEST_COLUMNS.items():
        if name not in requests.columns:
            requests = requests.withColumn(name, F.lit(None).cast(kind))
    return requests


def problem(dim: int | None = None) -> Column:
    """What is wrong with a request, or null."""
    created = F.col("created_at")
    seconds = F.concat(F.lit("created_at looks like seconds; use milliseconds: "), (created * 1000).cast("string"))
    out = F.when(F.length(F.trim(F.coalesce("text", F.lit("")))) == 0, "text is empty").when(created <= 0, "created_at must be positive").when(created < LEAST_CREATED_MS, seconds)
    if dim is not None:
        out = out.when(F.col("embedding").isNotNull() & (F.size("embedding") != dim), f"embedding must have {dim} dimensions")
    return out


def validated(requests: DataFrame, dim: int | None = None) -> DataFrame:
    return complete(requests).withColumn("problem", problem(dim))


def build(requests: DataFrame, now: int, namespace: str = "default", working_ttl: int | None = WORKING_TTL_S, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """Records of valid requests, with every default; ids are hashes of the request, so a recomputed row keeps its id.

    Equal requests of one batch are told apart by ``__seq`` where the batch has it.
    """
    r = complete(requests)
    kind, created = F.coalesce("kind", F.lit("episodic")), F.coalesce("created_at", F.lit(now))
    ttl = F.coalesce("ttl_seconds", F.when(kind == "working", F.lit(working_ttl).cast("bigint")))
    seq = F.col("__seq").cast("string") if "__seq" in r.columns else F.lit("")
    identity = F.concat_ws("\x1f", F.lit(namespace), seq, kind, F.coalesce("text", F.lit("")), created.cast("string"), F.coalesce("session_id", F.lit("")), F.coalesce("agent_id", F.lit("")))
    # texts that come with a vector are not embedded
    vector = F.coalesce(normalize(F.col("embedding")), (embed or hash_embed)(F.when(F.col("embedding").isNull(), F.col("text"))))
    none = F.array().cast("array<string>")
    tags = F.coalesce("tags", none)
    columns = {
        "id": F.md5(identity),
        "kind": kind,
        "text": F.col("text"),
        "created_at": created,
        "importance": F.least(F.greatest(F.coalesce("importance", F.lit(0.5)), F.lit(0.0)), F.lit(1.0)),
        "expires_at": created + ttl * 1000,
        "sources": F.coalesce("sources", none),
        "entities": extract_entities(F.col("text"), tags),
        "tags": tags,
        "session_id": F.col("session_id"),
        "agent_id": F.col("agent_id"),
        "visibility": F.coalesce("visibility", F.when(F.col("agent_id").isNotNull(), "private").otherwise("shared")),
        "metadata": F.col("metadata"),
        "embedding": vector,
    }
    extra = ["__seq"] if "__seq" in r.columns else []
    return r.select(*[columns[f.name].alias(f.name) for f in MEMORY], *extra)


def to_restore(snapshot: DataFrame, live: DataFrame) -> DataFrame:
    """Rows of a snapshot whose id is not live yet; ids and times stay, nothing is validated."""
    return snapshot.dropDuplicates(["id"]).join(live.select("id"), "id", "left_anti")


def snapshot(live: DataFrame, now: int, session_id: str | None = None) -> DataFrame:
    """Live, unexpired rows in the order of creation."""
    from .filters import matching

    return matching(live, session_id=session_id, now=now).orderBy("created_at", "id")


def page(live: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    """Newest first."""
    return live.orderBy(F.desc("created_at"), "id").offset(offset).limit(limit)


def nearest(queries: DataFrame, live: DataFrame) -> DataFrame:
    """(qid, id, score) of the most similar row of any kind."""
    from .knn import knn

    return knn(queries, live, 1).drop("rank")


def centroid(rows: DataFrame, by: str, vector: str = "embedding") -> DataFrame:
    """(by, embedding): the unit sum of each group's vectors, added up by position with map-side parts."""
    summed = rows.select(by, F.posexplode(vector).alias("pos", "x")).groupBy(by, "pos").agg(F.sum(F.col("x").cast("double")).alias("x"))
    gathered = summed.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias(vector))
    return gathered.withColumn(vector, normalize(F.col(vector)))
