"""The entity graph: mentions, co-occurrence edges, and recall along them. A record has at most 16 entities, so pairs are bounded."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import HOP_NEIGHBOURS, HOP_WEIGHT
from .knn import CONSTRAINTS, FILTERED_BY, blocks_of
from .ranking import top_k
from .termscan import Weights, best_rows_by_terms, held_by, with_terms


def mentions(records: DataFrame, key: str = "id") -> DataFrame:
    """(entity, id) of records with ``entities``."""
    return records.select(key, F.explode("entities").alias("entity"))


def edges(records: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(src, dst, cnt), both directions, or only from ``sources`` (src). Pairs are made inside a record's own array: nothing is joined."""
    pairs = F.flatten(F.transform("entities", lambda a: F.transform(F.filter("entities", lambda b: b != a), lambda b: F.struct(a.alias("src"), b.alias("dst")))))
    found = records.select(F.inline(pairs))
    if sources is not None:
        found = found.join(sources, "src", "left_semi")  # before anything is counted or shuffled
    return found.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("cnt"))


def rarity(df: Column) -> Column:
    return 1.0 / (1.0 + F.log(1.0 + df))


def top_entities(records: DataFrame, limit: int = 40) -> DataFrame:
    return mentions(records).groupBy("entity").agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.desc("cnt"), "entity").limit(limit)


def hops(query_entities: DataFrame, records: DataFrame) -> DataFrame:
    """(qid, entity, weight, hop) of query entities (qid, entity) and their most frequent neighbours."""
    df = mentions(records).groupBy("entity").agg(F.count(F.lit(1)).alias("df"))
    direct = query_entities.distinct().join(df, "entity").select("qid", "entity", rarity(F.col("df")).alias("weight"), F.lit(0).alias("hop"))
    best = neighbours(records, query_entities.select(F.col("entity").alias("src")).distinct())
    near = query_entities.distinct().withColumnRenamed("entity", "src").join(best, "src").join(df.withColumnRenamed("entity", "dst"), "dst")
    return direct.unionByName(near.select("qid", F.col("dst").alias("entity"), (HOP_WEIGHT * rarity(F.col("df")) * F.log(1.0 + F.col("cnt"))).alias("weight"), F.lit(1).alias("hop")))


def related(query_entities: DataFrame, records: DataFrame, hop: int | None = None) -> DataFrame:
    """(qid, id, score) of all related records: sums over query entities and hops, or over one hop only."""
    weights = hops(query_entities, records)
    if hop is not None:
        weights = weights.filter(F.col("hop") == hop)
    return mentions(records).join(weights, "entity").groupBy("qid", "id").agg(F.sum("weight").alias("score"))


def neighbours(records: DataFrame, sources: DataFrame) -> DataFrame:
    """(src, dst, cnt) of the most frequent neighbours of the given sources (src)."""
    place = F.row_number().over(W.partitionBy("src").orderBy(F.desc("cnt"), "dst"))
    return edges(records, sources).withColumn("n", place).filter(F.col("n") <= HOP_NEIGHBOURS).drop("n")


def _hop_weights(part: list[dict], near: dict[str, list[tuple[str, int]]], df: dict[str, int], hop: int | None) -> list[tuple[int, str, float]]:
    """(place of the request, entity, weight), sums over its entities and their neighbours; unknown entities have none."""
    sums: dict[tuple[int, str], float] = {}
    rare = {e: 1.0 / (1.0 + math.log(1.0 + n)) for e, n in df.items()}
    for i, r in enumerate(part):
        for e in r["entities"]:
            if hop != 1 and e in rare:
                sums[i, e] = sums.get((i, e), 0.0) + rare[e]
            for other, count in near.get(e, ()) if hop != 0 else ():
                sums[i, other] = sums.get((i, other), 0.0) + HOP_WEIGHT * rare[other] * math.log(1.0 + count)
    return [(i, e, w) for (i, e), w in sums.items()]


def related_topk(query_entities: DataFrame, records: DataFrame, k: int, requests: DataFrame | None = None, hop: int | None = None, now: int | None = None, block: int = 4096) -> DataFrame:
    """(qid, id, score, rank) of the k most related records; of those that meet a request, where ``requests`` (qid, constraints) are given.

    Requests are a stated set, taken in blocks; what comes to the driver are the entities of a block, five neighbours of each and their counts.
    A record's entities stand in its row, so it is scored where it lies; an entity of many records fills no task.
    """
    gathered = query_entities.groupBy("qid").agg(F.array_sort(F.collect_set("entity")).alias("entities"))
    if requests is not None:
        gathered = gathered.join(requests.select("qid", *CONSTRAINTS), "qid")
    masked = requests is not None or now is not None
    spark, out = records.sparkSession, None
    for part in blocks_of(gathered, block):
        names = sorted({e for r in part for e in r["entities"]})
        near: dict[str, list[tuple[str, int]]] = {}
        if hop != 0:
            sources = spark.createDataFrame([(e,) for e in names], "src string")
            for r in sorted(neighbours(records, sources).collect()):
                near.setdefault(r["src"], []).append((r["dst"], r["cnt"]))
        vocabulary = sorted({*names, *(e for found in near.values() for e, _ in found)})
        held = with_terms(records, "id", vocabulary, terms=F.col("entities"), more=[F.col(c) for c in FILTERED_BY] if masked else ())
        df = held_by(held, vocabulary)
        asked = Weights([{c: v for c, v in r.items() if c != "entities"} for r in part], _hop_weights(part, near, df, hop), vocabulary)
        one = best_rows_by_terms(held, asked, k, filtered=requests is not None, now=now)
        out = one if out is None else out.unionByName(one)
    return top_k(out, "score", k)
