"""Toxicity by a factorization machine over hashed terms.

Terms are words and word beginnings of 4 to 6 letters, hashed into ``buckets``; a document has a term or not. The
machine adds a weight per term and, for each pair of terms, the product of their factors: a pair such as
an insult and a mention of a group counts beyond the sum of its parts. It learns from a bounded sample of
labelled rows (``most`` of each class, chosen by a hash of the key); what the driver gathers and sends is bounded by ``most``
and ``buckets``.

No term is left out for its own lack of weight: all buckets that ``least`` rows of the sample hold are learned together, weights and
factors at once, by follow-the-regularised-leader steps. A weight stays zero, and a term's factors stay at their small start, until
the gradients they gathered exceed ``hold``; factors gather them through the other terms of a document, so a term that
means something only beside another is found too. After ``full`` passes, terms at less than half of both thresholds
are set aside, and the others go on for ``epochs`` more passes. Terms whose weight and factors never moved play no part in scores.

Defined results: a null or empty text has no term and gets the score of an empty document; repeated rows score alike;
labels without a document, or null, are not learned from; with no or one class of labels every score is 0.5 or less;
an empty table gives an empty result; language, source and key are never inputs; a text's score does not depend on what a worker read before.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

_MARKS = ".,;:!?%*#&$|<>\"'()[]{}-_=+/\\~`@^"
_LETTER = re.compile(r"[^\W\d_]")
BEGINNINGS = (4, 5, 6)


def words_of(text: str) -> set[str]:
    """Distinct words, lowered, without marks at their ends."""
    return {w.strip(_MARKS) for w in set(text.lower().split())}


def terms_of(word: str, buckets: int) -> list[int]:
    """Hashed terms of a word: itself and its beginnings."""
    if not word or not _LETTER.search(word):
        return []
    parts = ["=" + word] + [word[:n] for n in BEGINNINGS if len(word) >= n]
    return [zlib.crc32(p.encode()) % buckets for p in parts]


class _Terms:
    """Terms of texts by a cache of words, of at most ``most`` entries; ``chosen`` maps buckets to features, or None for all buckets."""

    def __init__(self, buckets: int, chosen: dict[int, int] | None = None, most: int = 400_000):
        self.buckets, self.chosen, self.most = buckets, chosen, most
        self.cache: dict[str, bytes] = {}

    def _packed(self, word: str) -> bytes:
        terms = terms_of(word, self.buckets)
        if self.chosen is not None:
            terms = [self.chosen[t] for t in terms if t in self.chosen]
        if len(self.cache) >= self.most:
            self.cache.clear()
        packed = self.cache[word] = np.array(terms, "<i4").tobytes()
        return packed

    def of(self, text: str) -> np.ndarray:
        """Distinct terms, ascending. What was found in the cache is kept when the cache is emptied in between."""
        words = list(words_of(text))
        found = list(map(self.cache.get, words))
        if None in found:
            found = [self._packed(w) if known is None else known for w, known in zip(words, found, strict=True)]
        return np.unique(np.frombuffer(b"".join(found), "<i4"))


@dataclass
class Machine:
    """Score = logistic(bias + sum of weights + sum over pairs of factor products)."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray
    chosen: dict[int, int]
    buckets: int

    def raw(self, rows: list) -> np.ndarray:
        ids, starts, sizes = _flat(rows)
        v = np.ascontiguousarray(self.factors.T)[:, ids]
        pairs = 0.5 * (_by_row(v, starts, sizes) ** 2 - _by_row(v**2, starts, sizes)).sum(axis=0)
        return self.bias + _by_row(self.weights[ids], starts, sizes) + pairs

    def score(self, rows: list) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(rows), -30, 30)))


def _flat(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms of all rows, the place of each row's first, and their numbers."""
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    ids = np.concatenate([np.asarray(r, np.int64) for r in rows]) if len(rows) else np.zeros(0, np.int64)
    return ids, np.cumsum(sizes) - sizes, sizes


def _by_row(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of each row's values, along the last axis."""
    out = np.zeros((*values.shape[:-1], len(sizes)))
    some = np.flatnonzero(sizes)
    if len(some):
        out[..., some] = np.add.reduceat(values, starts[some], axis=-1)
    return out


class _Leader:
    """State of the steps: gathered gradients and their squares; weights and factors follow from them."""

    def __init__(self, m: int, k: int, start: float, hold: float, rates: tuple[float, float], seed: int):
        self.still = np.random.default_rng(seed).choice([-start, start], (m, k))  # where factors rest
        self.w, self.v = np.zeros(m), self.still.copy()
        self.zw, self.nw, self.zv, self.nv = np.zeros(m), np.zeros(m), np.zeros((m, k)), np.zeros(m)
        self.bias, self.nb, self.hold, self.rates = 0.0, 1.0, hold, rates

    def step(self, y: np.ndarray, sizes: np.ndarray, starts: np.ndarray, u: np.ndarray, place: np.ndarray) -> None:
        """One batch; ``u``: its distinct terms, ``place``: the place in ``u`` of each row's terms."""
        now_w, now_v, still, nw, nv = (np.take(x, u, axis=0) for x in (self.w, self.v, self.still, self.nw, self.nv))
        v = np.take(np.ascontiguousarray(now_v.T), place, axis=1)
        sums = _by_row(v, starts, sizes)
        raw = self.bias + _by_row(np.take(now_w, place), starts, sizes) + 0.5 * (sums**2 - _by_row(v * v, starts, sizes)).sum(axis=0)
        error = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y
        g = np.bincount(place, np.repeat(error, sizes), len(u))
        toward = np.repeat(error * sums, sizes, axis=1)  # of the sums over all terms of the row, less the term's own part
        gv = np.column_stack([np.bincount(place, t, len(u)) for t in toward]) - g[:, None] * now_v
        more = nw + g * g
        z = np.take(self.zw, u) + g - (np.sqrt(more) - np.sqrt(nw)) / self.rates[0] * now_w
        self.zw[u], self.nw[u] = z, more
        self.w[u] = -np.sign(z) * np.maximum(np.abs(z) - self.hold, 0) * self.rates[0] / (1 + np.sqrt(more))
        more = nv + (gv * gv).sum(axis=1)
        z = np.take(self.zv, u, axis=0) + gv - ((np.sqrt(more) - np.sqrt(nv)) / self.rates[1])[:, None] * (now_v - still)
        self.zv[u], self.nv[u] = z, more
        part = np.maximum(1 - self.hold / np.maximum(np.sqrt((z * z).sum(axis=1)), 1e-12), 0)
        self.v[u] = still - z * (part * self.rates[1] / (1 + np.sqrt(more)))[:, None]
        self.nb += error.sum() ** 2
        self.bias -= self.rates[0] * error.sum() / np.sqrt(self.nb)

    def keep(self, which: np.ndarray) -> None:
        for name in ("w", "nw", "zw", "nv", "still", "v", "zv"):
            setattr(self, name, getattr(self, name)[which])


def train(rows: list, labels: np.ndarray, chosen: dict[int, int], buckets: int, k: int = 4, full: int = 2, epochs: int = 8, rates: tuple[float, float] = (0.3, 0.05), hold: float = 3.0, start: float = 0.01, batch: int = 64, seed: int = 1) -> Machine:
    """Steps on the logistic loss in small batches, in a fixed order. ``rows``: features, as ``chosen`` numbers the buckets."""
    m = len(chosen)
    if len(set(labels.tolist())) < 2:
        return Machine(-1.0 if not labels.any() else 0.0, np.zeros(m), np.zeros((m, k)), chosen, buckets)
    rng, state = np.random.default_rng(seed), _Leader(m, k, start, hold, rates, seed)
    state.bias = float(np.log(labels.mean() / (1 - labels.mean())))
    order, which = rng.permutation(len(rows)), np.arange(m)
    for epoch in range(full + epochs):
        if epoch == full:  # the terms that gathered too little are set aside
            stay = (np.abs(state.zw) >= hold / 2) | (np.linalg.norm(state.zv, axis=1) >= hold / 2)
            place = np.where(stay, np.cumsum(stay) - 1, -1)
            rows = [(p := place[r])[p >= 0] for r in rows]
            which = np.flatnonzero(stay)
            state.keep(which)
        for a in range(0, len(order), batch):
            part = order[a : a + batch]
            ids, starts, sizes = _flat([rows[i] for i in part])
            state.step(labels[part], sizes, starts, *np.unique(ids, return_inverse=True))
    moved = (state.w != 0) | (state.v != state.still).any(axis=1)
    names = np.empty(m, np.int64)
    names[list(chosen.values())] = list(chosen)
    kept = {int(b): i for i, b in enumerate(names[which[moved]])}
    return Machine(state.bias, state.w[moved], state.v[moved], kept, buckets)


def _sample(labels: DataFrame, key: str, label: str, most: int) -> DataFrame:
    """At most ``most`` rows of each class, by a hash of the key."""
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1)).select(F.col(key).cast("long").alias("__id"), F.col(label).cast("int").alias("__y"))
    of = lambda y: known.filter(F.col("__y") == y).orderBy(F.xxhash64("__id"), "__id").limit(most)
    return of(0).unionByName(of(1))


def _featurised(sample: DataFrame, buckets: int) -> DataFrame:
    """Rows (y, terms as packed int32) of a sample of (__y, __text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = _Terms(buckets)
        for batch in batches:
            packed = [terms.of(t).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["y", "terms"])

    return sample.select("__y", "__text").mapInArrow(run, "y int, terms binary")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", most: int = 10_000, buckets: int = 1 << 18, least: int = 3, **options) -> Machine:
    """Learn from the given labels. ``most``: labelled rows of each class to learn from; ``least``: rows of these that a bucket is in."""
    sample = _sample(labels, key, label, most)
    named = docs.select(F.col(key).cast("long").alias("__id"), text_or_empty(text).alias("__text"))
    # at most 2 * `most` ids: a broadcast of bounded size
    found = _featurised(named.join(F.broadcast(sample), "__id").select("__y", "__text"), buckets).toArrow()
    pairs = sorted(zip(found["terms"].to_pylist(), found["y"].to_pylist(), strict=True))  # the same model whatever the order of rows
    rows = [np.frombuffer(t, "<i4") for t, _ in pairs]
    seen = np.flatnonzero(np.bincount(np.concatenate(rows), minlength=buckets) >= least) if rows else np.zeros(0, np.int64)
    place = np.full(buckets, -1)
    place[seen] = np.arange(len(seen))
    rows = [(p := place[r])[p >= 0] for r in rows]
    return train(rows, np.array([y for _, y in pairs], float), {int(b): i for i, b in enumerate(seen)}, buckets, **options)


def score(docs: DataFrame, model: Machine, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row; the model's size is bounded by ``buckets`` and its factors."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        terms = _Terms(machine.buckets, machine.chosen)
        for batch in batches:
            rows = [terms.of(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(machine.score(rows), pa.float64())], [key, "score"])

    return docs.select(F.col(key).cast("long").alias(key), text_or_empty(text).alias("text")).mapInArrow(run, f"`{key}` bigint, score double")
