"""SimHash near-duplicates, found exactly: numpy exclusive-or and bit counts over tiles of fingerprints.

Fingerprints within ``radius`` bits agree on at least ``bands - radius`` of ``bands`` bit ranges, so every
linked pair meets under some choice of that many bands. The more distinct fingerprints there are, the more bands are taken, so that runs of
agreeing fingerprints stay short; the links are the same. Under each choice, distinct fingerprints are
range-partitioned and sorted by (agreeing bits, population count); runs of equal agreeing bits are compared in
tiles of at most ``tile`` fingerprints, and tile pairs whose population counts differ by more than the
radius are skipped. Runs of up to 16 fingerprints are compared many at once, without tiles, by their distance in the sorted order. A run of any
size is dealt out by range; its tiles are paired by their numbers, the pairs dealt to all tasks, and only then the tiles (packed binaries) fetched.
A tile pair gives a spanning forest of its links, never all pairs. Components of links come from
alternating star contractions on tables in the shared folder; the few centres that hold over a thousandth of all links are joined by broadcast.

Defined results: a text without words has fingerprint zero and is linked like any other; null text is such a text; copies
share a class; rows with a null id count in links but never name a component (null if no member has an id);
an empty table gives an empty result; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions, text_or_empty, unused


def shingle_hashes(raw: bytes, width: int = 4, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of each word shingle of UTF-8 text, in blocks; A-Z are lowered, words end at ASCII blanks."""
    from xxhash import xxh64_intdigest as digest

    words = raw.lower().split()
    if not words:
        return
    if len(words) <= width:
        yield np.array([digest(b" ".join(words), seed)], np.uint64)
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    first, last = begins[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    for at in range(0, len(first), 1 << 16):
        part = [digest(joined[a:b], seed) for a, b in zip(first[at : at + (1 << 16)], last[at : at + (1 << 16)], strict=True)]
        yield np.array(part, np.uint64)


def fingerprint(raw: bytes, width: int = 4, seed: int = 42) -> int:
    """64 bits; a bit is set if it is in over half of the hashes."""
    counts, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(raw, width, seed):
        counts += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0]) if n else 0


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, seed: int = 42, text_hash: str | None = None) -> DataFrame:
    """(key, fingerprint as a signed 64-bit integer) of every row; with a column ``text_hash``, XXH64 of its text, if asked."""
    more = [] if text_hash is None else [text_hash]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(x.as_buffer().to_pybytes(), width, seed) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64)), *batch.columns[2:]], [key, "fingerprint", *more])

    return docs.select(F.col(key).cast("long").alias(key), text_or_empty(text).cast("binary").alias("text"), *(F.xxhash64(text).alias(n) for n in more)).mapInArrow(run, f"`{key}` bigint, fingerprint bigint" + "".join(f", `{n}` bigint" for n in more))


def band_choices(radius: int, bands: int) -> list[list[tuple[int, int]]]:
    """For each choice of ``bands - radius`` bands: their (shift, width)."""
    if not 0 <= radius < bands <= 64:
        raise ValueError("bands must exceed the radius")
    edges = [round(64 * i / bands) for i in range(bands + 1)]
    cuts = [(a, b - a) for a, b in itertools.pairwise(edges)]
    return [list(c) for c in itertools.combinations(cuts, bands - radius)]


def bands_for(distinct: int, radius: int) -> int:
    """Bands for so many fingerprints: enough agreeing bits that random ones rarely agree, few choices otherwise."""
    wanted = max(1, distinct).bit_length() - 3
    agreeing = 2
    while 64 * agreeing // (radius + agreeing) < wanted and agreeing < 60 - radius:
        agreeing += 1
    return radius + agreeing


def _keyed(distinct: DataFrame, radius: int, bands: int) -> DataFrame:
    keys = []
    for number, choice in enumerate(band_choices(radius, bands)):
        value, width = F.lit(0).cast("long"), 0
        for shift, size in choice:
            part = F.shiftrightunsigned("fingerprint", shift).bitwiseAND(F.lit((1 << size) - 1))
            value, width = value.bitwiseOR(F.shiftleft(part, width)), width + size
        keys.append(F.struct(F.lit(number).alias("choice"), value.alias("bits")))
    return distinct.select(F.explode(F.array(*keys)).alias("k"), "fingerprint").select("k.choice", "k.bits", F.bit_count("fingerprint").cast("int").alias("ones"), "fingerprint")


def spanning_labels(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 with links u-v: the smallest node of each one's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        if np.array_equal(new, label):
            return label
        label = new


def compare_tiles(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between tiles ``a`` and ``b`` (or inside ``a``) as a spanning forest."""
    other = a if b is None else b
    close = np.bitwise_count(a[:, None] ^ other[None, :]) <= radius
    if b is None:
        close = np.triu(close, 1)
    i, j = np.nonzero(close)
    if len(i) <= len(a) + len(other):
        return a[i], other[j]
    nodes = a if b is None else np.concatenate([a, b])
    label = spanning_labels(len(nodes), i, j if b is None else j + len(a))
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


class _Tiler:
    """Cuts one partition's sorted rows into runs of equal keys and these into tiles."""

    FEW = 16  # runs up to this size are compared together, by distance in the sorted order

    def __init__(self, radius: int, tile: int, part: int):
        self.radius, self.tile, self.part, self.number = radius, tile, part, 0
        self.u: list[np.ndarray] = []
        self.v: list[np.ndarray] = []
        self.tiles: list[tuple] = []

    def links(self, u: np.ndarray, v: np.ndarray) -> None:
        if len(u):
            self.u.append(u)
            self.v.append(v)

    def few(self, keys: np.ndarray, prints: np.ndarray) -> None:
        for d in range(1, self.FEW):
            same = np.flatnonzero((keys[d:] == keys[:-d]).all(axis=1))
            if not len(same):
                break
            close = same[np.bitwise_count(prints[same] ^ prints[same + d]) <= self.radius]
            self.links(prints[close], prints[close + d])

    def run(self, key: np.ndarray, prints: np.ndarray, edge: bool) -> None:
        """A run or part of one; ``edge``: it may go on elsewhere, so that its tiles have to meet others."""
        edge |= len(prints) > self.tile
        for at in range(0, len(prints), self.tile):
            tile = prints[at : at + self.tile]
            if len(tile) > 1:
                self.links(*compare_tiles(tile, None, self.radius))
            if edge:
                ones = np.bitwise_count(tile)
                self.tiles.append((int(key[0]), int(key[1]), self.part << 32 | self.number, int(ones.min()), int(ones.max()), tile.tobytes()))
                self.number += 1

    def flush(self) -> pa.RecordBatch | None:
        u, v = (np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in (self.u, self.v))
        if not len(u) and not self.tiles:
            return None
        none, n = pa.nulls, len(u)
        cols = list(zip(*self.tiles, strict=True)) or [()] * 6
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        m = len(self.tiles)
        arrays = [pa.concat_arrays([pa.array(x), none(m, pa.int64())]) for x in (u, v)] + [pa.concat_arrays([none(n, t), pa.array(list(c), t)]) for c, t in zip(cols, types, strict=True)]
        self.u, self.v, self.tiles = [], [], []
        return pa.RecordBatch.from_arrays(arrays, ["u", "v", "choice", "bits", "tile", "low", "high", "prints"])


#: Parts of a run's tiles that are paired apart.
SALTS = 16


def links(distinct: DataFrame, radius: int = 4, bands: int = 6, tile: int = 1024) -> DataFrame:
    """Links (u, v) that connect just the fingerprints within ``radius`` bits of each other. ``distinct``: no fingerprint twice."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tiler = _Tiler(radius, tile, TaskContext.get().partitionId())
        keys, prints, first = np.zeros((0, 2), np.int64), np.zeros(0, np.uint64), True
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                new = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1)])
                keys = np.concatenate([keys, new])
                prints = np.concatenate([prints, batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64)])
            if not len(keys):
                continue
            begins = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
            ends = np.append(begins[1:], len(keys))
            over = batch is None
            stop = len(begins) if over else len(begins) - 1  # the last run may go on in the next batch
            small = np.zeros(len(keys), bool)
            for r in range(stop) if stop <= 2 else np.unique(np.concatenate([[0, stop - 1], np.flatnonzero((ends - begins)[:stop] > tiler.FEW)])):
                a, b = int(begins[r]), int(ends[r])
                edge = first and r == 0 or over and r == stop - 1
                if edge or b - a > tiler.FEW:
                    tiler.run(keys[a], prints[a:b], bool(edge))
                    small[a:b] = True
            done = int(ends[stop - 1]) if stop else 0
            rest = np.flatnonzero(~small[:done])
            if len(rest) > 1:
                tiler.few(keys[rest], prints[rest])
            first = first and not stop
            keys, prints = keys[done:], prints[done:]
            while len(keys) >= 4 * tile:  # one long run: full tiles go at once
                tiler.run(keys[0], prints[:tile], True)
                keys, prints, first = keys[tile:], prints[tile:], True
            if (out := tiler.flush()) is not None:
                yield out

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column(0), batch.column(1), strict=True):
                u, v = compare_tiles(np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64), radius)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    keyed = _keyed(distinct, radius, bands)
    order = ["choice", "bits", "ones", "fingerprint"]
    dealt = keyed.repartitionByRange(shuffle_partitions(distinct.sparkSession), *order).sortWithinPartitions(*order)
    built = materialize(dealt.mapInArrow(build, "u bigint, v bigint, choice int, bits bigint, tile bigint, low int, high int, prints binary"), "simhash-tiles")
    tiles = built.filter("tile IS NOT NULL")
    numbers = tiles.select("choice", "bits", "tile", "low", "high", F.pmod(F.xxhash64("tile"), F.lit(SALTS)).alias("salt"))
    a, b = numbers.alias("a"), numbers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).alias("b")
    near = (F.col("a.choice") == F.col("b.choice")) & (F.col("a.bits") == F.col("b.bits")) & (F.col("a.salt") == F.col("b.salt")) & (F.col("a.tile") < F.col("b.tile"))
    near &= (F.col("b.low") - F.col("a.high") <= radius) & (F.col("a.low") - F.col("b.high") <= radius)
    pairs = a.join(b, near).select(F.col("a.tile").alias("a"), F.col("b.tile").alias("b"))
    of = lambda x, y: tiles.select(F.col("tile").alias(x), F.col("prints").alias(y))
    crossing = pairs.join(of("a", "p"), "a").join(of("b", "q"), "b").select("p", "q").mapInArrow(meet, "u bigint, v bigint")
    return built.filter("u IS NOT NULL").select("u", "v").unionByName(crossing).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _with_least(pairs: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """``pairs`` (u, v) with ``low`` of ``least`` (at, low, n) for u; ``total`` bounds the number of pairs.

    Nodes with more than a thousandth of the pairs are at most a thousand: they are broadcast, so that none of them fills a task.
    """
    most = max(100, total // 1000)
    hubs = F.broadcast(least.filter(F.col("n") > most).select("at", "low"))
    others = least.filter(F.col("n") <= most).select("at", "low")
    busy = pairs.join(hubs, pairs["u"] == hubs["at"])
    rest = pairs.join(hubs.select("at"), pairs["u"] == hubs["at"], "left_anti")
    return busy.unionByName(rest.join(others, rest["u"] == others["at"])).drop("at")


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) of every node with a link; root is the component's smallest node. Alternating large-star and small-star steps."""
    edges, before = materialize(edges, "links"), None
    total = 2 * edges.count()
    for _ in range(most):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low"), F.count(F.lit(1)).alias("n")).select(F.col("u").alias("at"), F.least("u", "low").alias("low"), "n")
        large = _with_least(both, low, total).filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        large = large.filter("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("low"), F.count(F.lit(1)).alias("n")).select(F.col("u").alias("at"), "low", "n")
        small = _with_least(large, low, total).select(F.col("v").alias("u"), F.col("low").alias("v")).filter("u <> v")
        small = small.unionByName(low.select(F.col("at").alias("u"), F.col("low").alias("v"))).distinct()
        edges = materialize(small, "links")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before, total = now, 2 * now[0]
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _classes(prints: DataFrame, least: dict, radius: int, bands: int | None, tile: int) -> DataFrame:
    """(fingerprint, root, and the aggregates ``least``) of each fingerprint in ``prints``."""
    distinct = materialize(prints.groupBy("fingerprint").agg(*(c.alias(n) for n, c in least.items())), "distinct-fingerprints")
    roots = components(links(distinct.select("fingerprint"), radius, bands or bands_for(distinct.count(), radius), tile))
    return distinct.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, seed: int = 42, radius: int = 4, bands: int | None = None, tile: int = 1024) -> DataFrame:
    """(key, fingerprint as 16 hex digits, component_id: the smallest key that links lead to, its own included). ``bands``: by the number of fingerprints."""
    prints = materialize(fingerprints(docs, key, text, width, seed), "fingerprints")
    classes = _classes(prints, {"least": F.min(key)}, radius, bands, tile)
    named = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = classes.select("fingerprint", "root").join(named, "root").select("fingerprint", "component_id")
    return prints.join(classes, "fingerprint", "left").select(key, F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, seed: int = 42, radius: int = 4, bands: int | None = None, tile: int = 1024) -> DataFrame:
    """One row of each component stays: that of the smallest key (of rows that share it, the one with the smallest text hash).

    A row is known by key and text hash, so that rows of one key but different texts stay or go by their own components.
    Rows with a null key are dealt with among themselves: one of each component stays, that of the smallest text hash.
    """
    hashed, stay_key, stay, nth = unused([*docs.columns, "fingerprint"], "__text", "__key", "__stay", "__nth")
    prints = materialize(fingerprints(docs, key, text, width, seed, text_hash=hashed), "fingerprints")
    is_named = F.col(key).isNotNull()
    least = {"named": F.min(F.when(is_named, F.struct(F.col(key).alias("key"), F.col(hashed).alias("text")))), "unnamed": F.min(F.when(~is_named, F.col(hashed)))}
    first = _classes(prints, least, radius, bands, tile).groupBy("root").agg(F.min("named").alias("named"), F.min("unnamed").alias("unnamed"))
    chosen = first.select(F.explode(F.array("named", F.when(F.col("unnamed").isNotNull(), F.struct(F.lit(None).cast("long").alias("key"), F.col("unnamed").alias("text"))))).alias("s"))
    chosen = chosen.filter("s IS NOT NULL").select(F.col("s.key").alias(stay_key), F.col("s.text").alias(stay))
    kept = docs.withColumn(hashed, F.xxhash64(text)).join(chosen, F.col(key).eqNullSafe(F.col(stay_key)) & (F.col(hashed) == F.col(stay)))
    number = F.row_number().over(W.partitionBy(key, hashed).orderBy(hashed))
    return kept.withColumn(nth, number).filter(f"`{nth}` = 1").select(*docs.columns)
