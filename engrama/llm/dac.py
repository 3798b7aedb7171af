"""Token ids in a binary format of directly addressable codes.

An id is split into chunks of ``width`` bits, lowest first. Level 0 holds the first chunk of every id,
level k the k-th chunk of those ids that have one; each level but the last has a bitmap that says whether
an id goes on, and a rank directory (ones before every 512th bit). Any id is found by as many rank
steps as it has chunks, without decoding its neighbours.

File (all little-endian): magic ``DACT``, version u16, width u8, levels u8, documents u64, ids u64, documents without a key u64 (they come
first); document keys i64[n], document starts u64[n + 1]; then per level: entries u64, chunks, bitmap bytes
(a multiple of 64), directory u64[]. Chunks are whole bytes: width is 8 or 16.

Defined results: null text is empty (its end id alone is stored); null keys sort first and
are counted in the head; repeated rows are stored each, in the order of (key, text hash); an empty table gives no file and no row.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh_path, shuffle_partitions, text_or_empty
from .tokens import encoder, vocabulary_path

MAGIC, VERSION, BLOCK = b"DACT", 2, 512
_HEAD = struct.Struct("<4sHBBQQQ")


def encode_levels(ids: np.ndarray, width: int = 8) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per level: chunks, continuation bits (packed, little bit order), rank directory."""
    kind = {8: "<u1", 16: "<u2"}[width]
    rest, out = ids.astype("<u4"), []
    while True:
        chunks = (rest & ((1 << width) - 1)).astype(kind)
        rest = rest >> width
        goes_on = rest > 0
        last = not goes_on.any()
        bits = np.zeros(0, np.uint8) if last else _padded(np.packbits(goes_on, bitorder="little"))
        out.append((chunks, bits, rank_directory(bits)))
        if last:
            return out
        rest = rest[goes_on]


def _padded(bits: np.ndarray) -> np.ndarray:
    return np.concatenate([bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)])


def rank_directory(bits: np.ndarray) -> np.ndarray:
    ones = np.bitwise_count(bits.reshape(-1, BLOCK // 8)).sum(axis=1, dtype=np.uint64)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(ones, dtype=np.uint64)]).astype("<u8")


def to_bytes(keys: list[int | None], starts: list[int], ids: np.ndarray, width: int = 8) -> bytes:
    levels = encode_levels(ids, width)
    unnamed = keys.count(None)
    if None in keys[unnamed:]:
        raise ValueError("documents without a key come first")
    parts = [_HEAD.pack(MAGIC, VERSION, width, len(levels), len(keys), len(ids), unnamed), np.array([k or 0 for k in keys], "<i8").tobytes(), np.array([*starts, len(ids)], "<u8").tobytes()]
    for chunks, bits, directory in levels:
        parts += [struct.pack("<QQQ", len(chunks), len(bits), len(directory)), chunks.tobytes(), bits.tobytes(), directory.tobytes()]
    return b"".join(parts)


class Reader:
    """Random access to a file's ids and documents; arrays are views of ``raw``."""

    def __init__(self, raw: bytes):
        magic, version, self.width, levels, n, self.n_ids, self.unnamed = _HEAD.unpack_from(raw)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a file of directly addressable codes")
        at = _HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, count, at)
            at += out.nbytes
            return out

        self.keys, self.starts = take("<i8", n), take("<u8", n + 1)
        self.levels = []
        for _ in range(levels):
            entries, size, ranks = take("<u8", 3).tolist()
            self.levels.append((take("<u1" if self.width == 8 else "<u2", entries), take("<u1", size), take("<u8", ranks)))

    @staticmethod
    def _rank(bits: np.ndarray, directory: np.ndarray, at: int) -> int:
        """Ones before bit ``at``."""
        block = at // BLOCK
        whole = bits[block * (BLOCK // 8) : at // 8]
        part = int(bits[at // 8]) & ((1 << at % 8) - 1) if at % 8 else 0
        return int(directory[block]) + int(np.bitwise_count(whole).sum()) + part.bit_count()

    def __getitem__(self, i: int) -> int:
        """The i-th id, by one rank step per further chunk."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value, shift = 0, 0
        for chunks, bits, directory in self.levels:
            value |= int(chunks[i]) << shift
            shift += self.width
            if not len(bits) or not bits[i // 8] >> i % 8 & 1:
                break
            i = self._rank(bits, directory, i)
        return value

    def slice(self, a: int, b: int) -> np.ndarray:
        """Ids [a, b)."""
        out = self.levels[0][0][a:b].astype("<u4")
        where = None
        for level, (chunks, bits, directory) in enumerate(self.levels):
            if level:
                out[where] |= chunks[a:b].astype("<u4") << np.uint32(level * self.width)
            if not len(bits) or a == b:
                break
            flags = np.unpackbits(bits[a // 8 : (b + 7) // 8], bitorder="little")[a % 8 : a % 8 + b - a]
            going = np.flatnonzero(flags)
            where = going if where is None else where[going]
            a = self._rank(bits, directory, a)
            b = a + len(going)
        return out

    def document(self, i: int) -> np.ndarray:
        return self.slice(int(self.starts[i]), int(self.starts[i + 1]))


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else f"file://{uri}")


def write(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, end_id: int = 1, width: int = 8, file_ids: int = 4_000_000) -> DataFrame:
    """Write all ids in ascending key order; the manifest (one row per file) is returned, and kept as Parquet beside the files.

    Every attempt of a task writes files of its own name; only those in the manifest count, so a retried
    or repeated task does no harm. ``file_ids`` bounds a file and what a task holds (one document is never cut).
    """
    spark = docs.sparkSession
    path = path or fresh_path(spark, "token-files")
    vocab, end = vocabulary or vocabulary_path(), int(end_id).to_bytes(4, "little")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        files, folder = _filesystem(path)
        files.create_dir(folder, recursive=True)
        number, keys, starts, held, total = 0, [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, keys, starts, held, total
            raw = to_bytes(keys, starts, np.frombuffer(b"".join(held), "<u4"), width)
            name = f"{folder}/ids-{part:06d}-{number:04d}-{uuid.uuid4().hex}.dac"
            with files.open_output_stream(name + ".tmp") as out:
                out.write(raw)
            files.move(name + ".tmp", name)
            row = [[part], [number], [name.rpartition("/")[2]], [len(keys)], [total], [len(raw)]]
            number, keys, starts, held, total = number + 1, [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()], strict=True)], ["part", "number", "file", "n_docs", "n_ids", "n_bytes"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                several = encoder(vocab).encode(batch.column(1).slice(at, 256).to_pylist())
                for k, ids in zip(batch.column(0).slice(at, 256).to_pylist(), several, strict=True):
                    ids += end
                    if keys and total + len(ids) // 4 > file_ids:
                        yield flush()
                    keys.append(k)
                    starts.append(total)
                    held.append(ids)
                    total += len(ids) // 4
        if keys:
            yield flush()

    plain = docs.select(F.col(key).cast("long").alias("key"), text_or_empty(text).alias("text"))
    dealt = plain.repartitionByRange(shuffle_partitions(spark), F.col("key").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("key").asc_nulls_first(), F.xxhash64("text"))
    manifest = dealt.mapInArrow(store, "part bigint, number bigint, file string, n_docs bigint, n_ids bigint, n_bytes bigint")
    manifest.write.parquet(f"{path}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{path}/manifest").withColumn("folder", F.lit(path))


def read(manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per stored document, from the files: key, start (ids of all documents before it), n_tokens, ids (little-endian bytes)."""
    # one row per writing task stands in the one window without partitions; files are numbered within their task
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("in_part"))
    parts = parts.withColumn("before", F.sum("in_part").over(W.orderBy("part")) - F.col("in_part"))
    inside = F.sum("n_ids").over(W.partitionBy("part").orderBy("number")) - F.col("n_ids")
    files = manifest.withColumn("inside", inside).join(parts, "part")
    files = files.select(F.concat_ws("/", "folder", "file").alias("file"), (F.col("before") + F.col("inside")).alias("begin"), "part", "number")
    files = files.repartitionByRange(shuffle_partitions(manifest.sparkSession), "part", "number").select("file", "begin")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, place = _filesystem(name)
                with store.open_input_file(place) as f:
                    reader = Reader(f.read())
                keys = [None] * reader.unnamed + reader.keys[reader.unnamed :].tolist()
                bounds = reader.starts.astype(np.int64)
                step = 2_000_000
                at = 0
                while at < len(keys):
                    stop = max(at + 1, int(np.searchsorted(bounds, bounds[at] + step, side="right")) - 1)
                    ids = reader.slice(int(bounds[at]), int(bounds[stop])).tobytes()
                    cuts = ((bounds[at : stop + 1] - bounds[at]) * 4).astype(np.int32)
                    binary = pa.BinaryArray.from_buffers(pa.binary(), stop - at, [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(ids)])
                    yield pa.RecordBatch.from_arrays([pa.array(keys[at:stop], pa.int64()), pa.array(bounds[at:stop] + first), pa.array(np.diff(bounds[at : stop + 1])), binary], [key, "start", "n_tokens", "ids"])
                    at = stop

    return files.mapInArrow(load, f"`{key}` bigint, start bigint, n_tokens bigint, ids binary")
