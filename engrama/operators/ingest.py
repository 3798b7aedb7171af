"""Conversation ingest: raw turns, candidate facts, deduplication, superseding."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import DEDUP_COSINE, KINDS, MOST_FACTS


def raw_turns(turns: DataFrame) -> DataFrame:
    """Requests of ``role: text``, episodic."""
    return turns.withColumn("text", F.concat(F.col("role"), F.lit(": "), F.col("text"))).withColumn("kind", F.lit("episodic"))


def json_array(raw: str) -> list:
    """The outermost array in a model's answer; ValueError without one."""
    a, b = raw.find("["), raw.rfind("]")
    if not 0 <= a < b:
        raise ValueError("no JSON array in the answer")
    return json.loads(raw[a : b + 1])


def parse_candidates(raw: str, most: int = MOST_FACTS) -> list[dict]:
    """Facts of an answer; malformed entries are dropped."""
    out = []
    for item in json_array(raw):
        text = item.get("text") if isinstance(item, dict) else None
        if not isinstance(text, str) or not text.strip():
            continue
        weight = item.get("importance")
        weight = float(weight) if isinstance(weight, int | float) and not isinstance(weight, bool) else 0.5
        kind = item.get("kind")
        out.append({"text": text.strip(), "kind": kind if kind in KINDS else "semantic", "importance": min(1.0, max(0.0, weight)), "tags": []})
        if len(out) == most:
            break
    return out


def parse_indices(raw: str, n: int) -> list[int]:
    """Zero-based places of 1-based numbers in an answer, those in range."""
    return [int(i) - 1 for i in json_array(raw) if isinstance(i, int | float) and not isinstance(i, bool) and float(i).is_integer() and 1 <= i <= n]


def candidates_of(exchanges: DataFrame, extractor: Callable[[str, list[str]], str], most: int = MOST_FACTS) -> DataFrame:
    """(exchange, place, text, kind, importance) from an extractor called with (conversation, known facts); one-to-many, Arrow-batched.

    ``exchanges``: exchange, conversation, known (array). A failing extractor gives no rows.
    """

    def run(frames):
        for pdf in frames:
            rows = []
            for e, c, k in zip(pdf["exchange"], pdf["conversation"], pdf["known"], strict=True):
                try:
                    found = parse_candidates(extractor(c, list(k) if k is not None else []), most)
                except Exception:  # noqa: BLE001  a plugged-in model may fail in any way
                    found = []
                rows += [(e, i, f["text"], f["kind"], f["importance"]) for i, f in enumerate(found)]
            yield pd.DataFrame(rows, columns=["exchange", "place", "text", "kind", "importance"])

    return exchanges.select("exchange", "conversation", "known").mapInPandas(run, "exchange string, place int, text string, kind string, importance double")


def new_facts(candidates: DataFrame, live: DataFrame, threshold: float = DEDUP_COSINE, live_already: bool = False) -> DataFrame:
    """Candidates (qid, query_embedding, ...) without a live row of any kind at ``threshold`` or nearer.

    ``live_already``: candidates are live rows themselves, and the row whose id is ``qid`` is left out.
    """
    from .knn import knn

    near = knn(candidates, live, 2 if live_already else 1).filter(F.round("score", 9) >= threshold)
    if live_already:
        near = near.filter(F.col("id") != F.col("qid"))
    return candidates.join(near.select("qid"), "qid", "left_anti")


def greedy_distinct(candidates: DataFrame, threshold: float = DEDUP_COSINE, group: str = "exchange", order: str = "place", vector: str = "embedding") -> DataFrame:
    """Per exchange, in order: a candidate stays if no one that stayed is as near as ``threshold``. An exchange has few candidates."""

    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        kept: list[np.ndarray] = []
        stays = []
        for v in pdf[vector]:
            v = np.asarray(v, float)
            new = all(round(float(v @ k), 9) < threshold for k in kept)
            if new:
                kept.append(v)
            stays.append(new)
        return pdf[stays]

    return candidates.groupBy(group).applyInPandas(apply, candidates.schema)


def reports(turns: DataFrame, found: DataFrame, kept: DataFrame, group: str = "exchange") -> DataFrame:
    """(group, raw, extraction_ran, facts, duplicates) of exchanges: their turns, the facts found in them, and those that were kept."""
    count = lambda rows, name: rows.groupBy(F.col(group).alias("__of")).agg(F.count(F.lit(1)).alias(name))
    out = turns.groupBy(group).agg(F.count(F.lit(1)).alias("raw"))
    for rows, name in ((found, "found"), (kept, "facts")):
        one = count(rows, name)
        out = out.join(one, out[group].eqNullSafe(one["__of"]), "left").drop("__of").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return out.select(group, "raw", (F.col("found") > 0).alias("extraction_ran"), "facts", (F.col("found") - F.col("facts")).alias("duplicates"))
