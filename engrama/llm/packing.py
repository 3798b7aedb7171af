"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

1. Documents are tokenised and cut into pieces of at most ``length`` ids (``tokenize_pieces``).
2. Lengths take at most ``length`` values, so a histogram of that many rows is all the driver gets.
3. ``best_two_fit`` plans whole *patterns*: a bin is filled greedily, longest first; then its smallest
   piece gives way to the two unpacked pieces that fill the widened gap best, if they fill it better.
   While the counts last, the next bin would come out the same, so a pattern is repeated in bulk:
   the plan's size depends on ``length``, not on the number of documents.
4. Each piece gets its rank among the pieces of its length (salted, so a length that a third of all
   pieces share is dealt to many tasks) and from that its sequence and offset.

Defined results: null text counts as empty (a lone end id); repeated rows are packed each; rows with a null
key are packed like any other; an empty table gives an empty result; other columns, whatever their names, are ignored by
``pack_documents`` and kept by ``pack``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions, text_or_empty, unused
from .tokens import encoder, vocabulary_path

PIECES = "{key} bigint, piece int, start bigint, length bigint, ids binary"


def tokenize_pieces(docs: DataFrame, length: int = 2048, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, end_id: int = 0) -> DataFrame:
    """Pieces of at most ``length`` ids (``ids``: little-endian unsigned 32-bit); each document ends with ``end_id``."""
    path, end = vocabulary or vocabulary_path(), int(end_id).to_bytes(4, "little")
    schema = pa.schema([(key, pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            out: list[tuple] = []
            size = 0
            for at in range(0, len(keys), 256):
                texts = batch.column(1).slice(at, 256).to_pylist()
                for k, ids in zip(keys[at : at + 256], encoder(path).encode(texts), strict=True):
                    ids += end
                    for i, a in enumerate(range(0, len(ids), 4 * length)):
                        part = ids[a : a + 4 * length]
                        out.append((k, i, a // 4, len(part) // 4, part))
                        size += len(part)
                if size > 32_000_000:
                    yield _batch(out, schema)
                    out, size = [], 0
            if out:
                yield _batch(out, schema)

    return docs.select(F.col(key).cast("long").alias(key), text_or_empty(text).alias("text")).mapInArrow(cut, PIECES.format(key=f"`{key}`"))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


@dataclass
class Plan:
    """Runs of places for the pieces of one length, in the order of their ranks.

    Ranks ``[first[i], first[i + 1])`` of length ``size[i]`` go ``times[i]`` to a bin,
    from bin ``bin[i]`` on, at ``offset[i]`` and the places after it.
    """

    size: np.ndarray
    first: np.ndarray
    times: np.ndarray
    bin: np.ndarray
    offset: np.ndarray
    bins: int

    def place(self, sizes: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begins = np.searchsorted(self.size, sizes)
        ends = np.searchsorted(self.size, sizes, side="right")
        while np.any(begins + 1 < ends):  # the last run that starts at or before the rank
            middle = (begins + ends) // 2
            right = (self.first[np.minimum(middle, len(self.first) - 1)] <= ranks) & (middle < ends)
            begins, ends = np.where(right, middle, begins), np.where(right, ends, np.maximum(middle, begins + 1))
        within = ranks - self.first[begins]
        times = self.times[begins]
        return self.bin[begins] + within // times, self.offset[begins] + within % times * sizes


def _greedy(counts: np.ndarray, capacity: int) -> dict[int, int]:
    """Largest remaining length that fits, again and again."""
    taken: dict[int, int] = {}
    present = np.flatnonzero(counts)
    while len(present) and capacity:
        present = present[: np.searchsorted(present, capacity, side="right")]
        if not len(present):
            break
        largest = int(present[-1])
        n = min(int(counts[largest]), capacity // largest)
        taken[largest] = n
        capacity -= n * largest
        present = present[:-1]
    return taken


def _two_best(counts: np.ndarray, taken: dict[int, int], gap: int) -> tuple[int, int] | None:
    """The two unpacked lengths with the largest sum up to ``gap``; of equal sums the pair with the shortest member."""
    left = counts.copy()
    for size, n in taken.items():
        left[size] -= n
    present = np.flatnonzero(left)
    present = present[present < gap]
    if not len(present):
        return None
    at = np.searchsorted(present, gap - present, side="right") - 1
    partner = np.where(at >= 0, present[np.maximum(at, 0)], 0)
    alone = (partner == present) & (left[present] < 2)
    before = np.where(at > 0, present[np.maximum(at - 1, 0)], 0)
    partner = np.where(alone, before, partner)
    sums = np.where(partner > 0, partner + present, 0)
    best = int(np.argmax(sums))
    return (int(present[best]), int(partner[best])) if sums[best] else None


def best_two_fit(histogram: dict[int, int], capacity: int) -> Plan:
    """Plan bins for ``histogram`` (length -> number of pieces)."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for size, n in histogram.items():
        if not 0 < size <= capacity:
            raise ValueError(f"length {size} is not in 1..{capacity}")
        counts[size] = n
    used = np.zeros(capacity + 1, dtype=np.int64)
    runs: list[tuple[int, int, int, int, int]] = []
    bins = 0
    while counts.any():
        taken = _greedy(counts, capacity)
        room = capacity - sum(s * n for s, n in taken.items())
        if room and sum(taken.values()) > 1:
            smallest = min(taken)
            widened = dict(taken)
            widened[smallest] -= 1
            if not widened[smallest]:
                del widened[smallest]
            without = counts.copy()
            without[smallest] -= 1  # the piece that goes is not one of the two
            two = _two_best(without, widened, room + smallest)
            if two and sum(two) > smallest:
                for size in two:
                    widened[size] = widened.get(size, 0) + 1
                taken = widened
        repeat = min(int(counts[s]) // n for s, n in taken.items())
        offset = 0
        for size in sorted(taken, reverse=True):
            n = taken[size]
            runs.append((size, int(used[size]), n, bins, offset))
            used[size] += n * repeat
            counts[size] -= n * repeat
            offset += n * size
        bins += repeat
    columns = [np.array(c, dtype=np.int64) for c in zip(*sorted(runs), strict=True)] if runs else [np.zeros(0, np.int64)] * 5
    return Plan(*columns, bins=bins)


def pack(pieces: DataFrame, length: int = 2048, order: tuple[str, ...] = ("doc_id", "piece"), salts: int | None = None) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``. ``pieces`` needs ``length`` and must not change when read again.

    ``salts``: into so many groups the pieces of one length are dealt before they are ranked; as many as shuffle partitions, 64 at least.
    """
    spark = pieces.sparkSession
    salts = salts or max(64, shuffle_partitions(spark))
    salt, rank, n, earlier = unused(pieces.columns, "__salt", "__rank", "__n", "__before")
    salted = pieces.withColumn(salt, F.pmod(F.xxhash64(*order), F.lit(salts)))
    groups = salted.groupBy("length", salt).agg(F.count(F.lit(1)).alias(n))
    counted = materialize(groups, "packing-groups")  # at most length * salts rows
    histogram = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum(n).alias("n")).collect()}  # at most `length` rows
    plan = spark.sparkContext.broadcast(best_two_fit(histogram, length))
    before = counted.withColumn(earlier, F.sum(n).over(W.partitionBy("length").orderBy(salt)) - F.col(n)).drop(n)
    inside = F.row_number().over(W.partitionBy("length", salt).orderBy(*order)) - 1
    ranked = salted.withColumn(rank, inside.cast("long")).join(before, ["length", salt]).withColumn(rank, F.col(rank) + F.col(earlier))
    names = pieces.columns
    ranked = ranked.select(*names, rank)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id bigint, offset bigint"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(names.index("length")).to_numpy(zero_copy_only=False)
            bin_, offset = plan.value.place(size, batch.column(len(names)).to_numpy(zero_copy_only=False))
            columns = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(bin_, pa.int64()), pa.array(offset, pa.int64())], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, length: int = 2048, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, end_id: int = 0) -> DataFrame:
    """Pieces of all documents with their sequence and place; without the ids, but with their checksum."""
    pieces = tokenize_pieces(docs, length, key, text, vocabulary, end_id)
    pieces = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    order = (key, "piece", "start", "length", "ids_crc32")  # rows that tie in all of these are interchangeable
    return pack(materialize(pieces, "packing-pieces"), length, order)


def sequences(placed: DataFrame, pieces: DataFrame, key: str = "doc_id") -> DataFrame:
    """The packed ids themselves: one row per sequence. Needs unique (key, piece); a sequence's pieces are few and bounded."""
    together = placed.select(key, "piece", "sequence_id", "offset").join(pieces.select(key, "piece", "ids"), [key, "piece"])
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: F.hex(x["ids"]))
    return together.groupBy("sequence_id").agg(F.unhex(F.concat_ws("", parts)).alias("ids"))
