"""Best rows of a scan by weighted terms: what lexical search and the entity graph have in common.

A stated set of requests gives weights to terms; a row holds all its terms, so its score needs nothing but the row. Rows are scored in Arrow
batches where they lie, filters hold before anything is cut, and each batch gives at most k rows a request: these alone are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .knn import FILTERED_BY, best_rows, constraints_of, eligible

#: Scores held at once: requests times rows of a part of a batch.
MOST_SCORES = 4_000_000
#: What separates terms, for Arrow's regular expressions.
NO_TERM = r"[^\pL\pN]+"


def found_terms(lists: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, terms (places in ``vocabulary``) and counts of asked terms, in the order of (row, term); and the lengths of all rows, empty terms left out."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    at = np.repeat(np.arange(len(sizes)), sizes)
    empty = pc.fill_null(pc.equal(pc.binary_length(flat), 0), True).to_numpy(zero_copy_only=False)
    ids = pc.fill_null(pc.index_in(flat, value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
    n = max(1, len(vocabulary))
    distinct, counts = np.unique((at * n + ids)[ids >= 0], return_counts=True)
    return distinct // n, distinct % n, counts, sizes - np.bincount(at[empty], minlength=len(sizes))


def with_terms(rows: DataFrame, key: str, vocabulary: list[str], terms: Column | None = None, text: Column | None = None, more: Sequence[Column] = ()) -> DataFrame:
    """(key, size, ids, counts, more): the places in ``vocabulary`` of the terms a row holds, from an array of ``terms`` or a ``text``."""
    shared, split = rows.sparkSession.sparkContext.broadcast(vocabulary), terms is None
    whole = rows.select(F.col(key), (F.lower(F.coalesce(text, F.lit(""))) if terms is None else terms).alias("__terms"), *more)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in whole.schema[2:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = pa.array(shared.value, pa.string())
        for batch in batches:
            lists = batch.column(1)
            row, term, count, size = found_terms(pc.split_pattern_regex(lists, NO_TERM) if split else lists, asked)
            ends = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32())
            ids, counts = (pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (term, count))
            names = [key, "size", "ids", "counts", *batch.schema.names[2:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), ids, counts, *batch.columns[2:]], names)

    return whole.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, size bigint, ids array<int>, counts array<int>" + (", " + kept if kept else ""))


class Weights:
    """Weights by request and term, arranged by term."""

    def __init__(self, requests: list[dict], weights: list[tuple[int, str, float]], vocabulary: list[str]):
        """``weights``: (place of the request, term of ``vocabulary``, weight), each pair once."""
        self.requests = requests
        place = {t: i for i, t in enumerate(vocabulary)}
        ordered = sorted((place[t], q, w) for q, t, w in weights)
        at, self.asked, self.weight = (np.array(c, d) for c, d in zip(zip(*ordered, strict=True), (np.int64, np.int64, float), strict=True)) if ordered else (np.zeros(0, np.int64),) * 3
        self.begins = np.searchsorted(at, np.arange(len(vocabulary) + 1))

    def scores(self, rows: np.ndarray, terms: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        """(request, row) -> sum of weight times value; ``rows`` and ``terms`` name each pair once."""
        out = np.zeros((len(self.requests), n))
        order = np.argsort(terms, kind="stable")
        rows, terms, values = rows[order], terms[order], values[order]
        starts = np.flatnonzero(np.diff(terms, prepend=-1))
        for a, b in zip(starts, np.append(starts[1:], len(terms)), strict=True):
            i, j = self.begins[terms[a]], self.begins[terms[a] + 1]
            out[np.ix_(self.asked[i:j], rows[a:b])] += np.outer(self.weight[i:j], values[a:b])
        return out


def best_rows_by_terms(found: DataFrame, weights: Weights, k: int, key: str = "id", saturate: tuple[float, float, float] | None = None, filtered: bool = False, now: int | None = None) -> DataFrame:
    """(qid, key, score) of at most k rows a request and batch, of rows of ``with_terms`` that hold a weighted term.

    A term's value in a row is 1, or with ``saturate`` = (k1, b, average length) its saturated frequency there.
    ``filtered``: rows meet the request's constraints; ``now``: they have not expired; ``found`` then has the columns these look at.
    """
    shared = found.sparkSession.sparkContext.broadcast(weights)
    masked = filtered or now is not None
    rows = found.select(key, "size", "ids", "counts", *(FILTERED_BY if masked else ())).filter(F.size("ids") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        qids = np.array([r["qid"] for r in asked.requests])
        step = max(1, MOST_SCORES // max(1, len(qids)))
        for whole in batches:
            for first in range(0, whole.num_rows, step):
                batch = whole.slice(first, step)
                size, ids, counts = (batch.column(i) for i in (1, 2, 3))
                row = np.repeat(np.arange(batch.num_rows), ids.value_lengths().to_numpy(zero_copy_only=False))
                term, count = (x.flatten().to_numpy(zero_copy_only=False) for x in (ids, counts))
                value = np.ones(len(row))
                if saturate is not None:
                    k1, b, average = saturate
                    value = count * (k1 + 1) / (count + k1 * (1 - b + b * size.to_numpy(zero_copy_only=False)[row] / average))
                scores = asked.scores(row, term, value, batch.num_rows)
                keys = batch.column(0).to_numpy(zero_copy_only=False)
                place = np.empty(len(keys), np.int64)
                place[np.argsort(keys, kind="stable")] = np.arange(len(keys))
                facts = pa.Table.from_batches([batch]).select(batch.schema.names[4:]).to_pandas() if masked else None
                masks: dict[tuple, np.ndarray] = {}  # requests of equal constraints share one
                best = []
                for i, request in enumerate(asked.requests):
                    usable = scores[i] > 0
                    if facts is not None:
                        same = constraints_of(request) if filtered else ()
                        if same not in masks:
                            masks[same] = eligible(request if filtered else {}, facts, now)
                        usable &= masks[same]
                    best.append(best_rows(scores[i], place, k, np.flatnonzero(usable)))
                sizes = [len(x) for x in best]
                if sum(sizes):
                    at, by = np.concatenate(best), np.repeat(np.arange(len(qids)), sizes)
                    yield pa.RecordBatch.from_arrays([pa.array(qids[by], pa.int64()), batch.column(0).take(pa.array(at)), pa.array(scores[by, at])], ["qid", key, "score"])

    return rows.mapInArrow(run, f"qid bigint, `{key}` {found.schema[key].dataType.simpleString()}, score double")


def held_by(found: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Rows that hold each asked term; a row per asked term comes to the driver."""
    counts = found.select(F.explode("ids").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return {vocabulary[r["term"]]: r["n"] for r in counts.collect()}


def term_statistics(found: DataFrame, vocabulary: list[str]) -> tuple[dict[str, int], int, int]:
    """Rows that hold each asked term, all rows, and all terms of all rows."""
    whole = found.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("total")).first()
    return held_by(found, vocabulary), whole["n"], whole["total"]
