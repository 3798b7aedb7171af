"""Media columns: Ogg physical streams as binary values.

Reading verifies each page's checksum, skips damage up to the next capture pattern, reassembles packets from
lacing values (also across pages), keeps logical streams apart by serial number and derives times
from granule positions. Writing multiplexes logical streams in the same format.

``store_texts`` keeps a text's UTF-8 bytes, padded with blanks, as 8-bit samples of one stream; a second stream holds
the unpadded length. Null text counts as empty; equal texts give equal bytes; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

CAPTURE = b"OggS"
CONTINUED, FIRST, LAST = 1, 2, 4
_HEAD = struct.Struct("<4sBBqIIIB")
_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
NO_GRANULE = -1

SAMPLES, NOTES = 0x53414D50, 0x4E4F5445
_SAMPLES_HEAD = struct.Struct("<8sII")  # codec, samples a second, bits
_NOTES_HEAD = struct.Struct("<8sI")
SAMPLE_CODEC, NOTE_CODEC = b"raw-u8\0\0", b"length\0\0"


def checksum(data: bytes) -> int:
    """CRC of polynomial 0x04C11DB7, most significant bit first, from zero: zlib's with each byte's bits mirrored."""
    mirrored = zlib.crc32(data.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_MIRROR), "big")


@dataclass
class Packet:
    serial: int
    data: bytes
    granule: int = NO_GRANULE  # of the page it ends on, if it is the last to end there


@dataclass
class Stream:
    serial: int
    packets: list[Packet] = field(default_factory=list)
    pages: int = 0
    lost: int = 0  # pages missing by sequence number
    torn: int = 0  # packets given up for want of a part
    ended: bool = False
    granule: int = 0

    def seconds(self, rate: int) -> float:
        return self.granule / rate


@dataclass
class Media:
    streams: dict[int, Stream] = field(default_factory=dict)
    pages: int = 0
    bad_pages: int = 0
    skipped: int = 0  # bytes that belong to no good page


def demultiplex(raw: bytes) -> Media:
    """All logical streams of ``raw``; damaged pages are left out and counted."""
    media, at, n = Media(), 0, len(raw)
    partial: dict[int, bytearray | None] = {}
    expected: dict[int, int] = {}
    while at < n:
        found = raw.find(CAPTURE, at)
        if found < 0:
            media.skipped += n - at
            break
        media.skipped += found - at
        at = found
        body = at + 27
        if body > n:
            media.skipped += n - at
            break
        _, version, flags, granule, serial, sequence, crc, count = _HEAD.unpack_from(raw, at)
        lacing = raw[body : body + count]
        body += count
        end = body + sum(lacing)
        if version or len(lacing) < count or end > n or checksum(raw[at : at + 22] + b"\0\0\0\0" + raw[at + 26 : end]) != crc:
            media.bad_pages += 1
            media.skipped += 1
            at += 1
            continue
        media.pages += 1
        stream = media.streams.get(serial)
        if stream is None or flags & FIRST and stream.ended:
            if stream is None:
                stream = media.streams[serial] = Stream(serial)
            stream.ended = False
            expected.pop(serial, None)
        held = partial.pop(serial, None)
        gap = sequence != expected.get(serial, sequence)
        if gap:
            stream.lost += (sequence - expected[serial]) & 0xFFFFFFFF
        if held is not None and (gap or not flags & CONTINUED):
            stream.torn += 1
            held = None
        whole = held is not None or not flags & CONTINUED  # else the page begins inside a packet whose start is lost
        held = held if held is not None else bytearray()
        if not whole:
            stream.torn += 1
        last = None
        for size in lacing:
            held += raw[body : body + size]
            body += size
            if size < 255:
                if whole:
                    last = Packet(serial, bytes(held))
                    stream.packets.append(last)
                held, whole = bytearray(), True
        if lacing and lacing[-1] == 255:
            partial[serial] = held if whole else None
        if last is not None:
            last.granule = granule
        if granule != NO_GRANULE:
            stream.granule = max(stream.granule, granule)
        stream.pages += 1
        stream.ended = bool(flags & LAST)
        expected[serial] = (sequence + 1) & 0xFFFFFFFF
        at = end
    for serial, held in partial.items():
        if held is not None:
            media.streams[serial].torn += 1
    return media


class _Writer:
    def __init__(self, serial: int):
        self.serial, self.sequence = serial, 0

    def page(self, lacing: bytes, body: bytes, granule: int, flags: int) -> bytes:
        head = _HEAD.pack(CAPTURE, 0, flags, granule, self.serial, self.sequence, 0, len(lacing)) + lacing
        self.sequence += 1
        crc = checksum(head + body)
        return head[:22] + crc.to_bytes(4, "little") + head[26:] + body

    def pages(self, packets: list[tuple[bytes, int]], last: bool) -> Iterator[tuple[int, bytes]]:
        """(granule, page) of packets given with their end granules; ``last`` marks the final page."""
        lacing, body, granule, carried, out = bytearray(), bytearray(), NO_GRANULE, False, []
        for data, end in packets:
            at, sizes = 0, [255] * (len(data) // 255) + [len(data) % 255]
            for i, size in enumerate(sizes):
                if len(lacing) == 255:
                    out.append((bytes(lacing), bytes(body), granule, carried))
                    carried = i > 0
                    lacing, body, granule = bytearray(), bytearray(), NO_GRANULE
                lacing.append(size)
                body += data[at : at + size]
                at += size
            granule = end
        if lacing:
            out.append((bytes(lacing), bytes(body), granule, carried))
        for i, (sizes, data, granule, carried) in enumerate(out):
            yield granule, self.page(sizes, data, granule, CONTINUED * carried | LAST * (last and i == len(out) - 1))


def multiplex(streams: dict[int, list[tuple[bytes, int]]]) -> bytes:
    """A physical stream of ``serial -> [(packet, end granule)]``; the first packet of each is its header, alone on its page."""
    writers = {serial: _Writer(serial) for serial in streams}
    out = [writers[s].page(bytes([255] * (len(p[0][0]) // 255) + [len(p[0][0]) % 255]), p[0][0], 0, FIRST | LAST * (len(p) == 1)) for s, p in streams.items()]
    rest = [(granule, i, page) for i, (s, p) in enumerate(streams.items()) for granule, page in writers[s].pages(p[1:], True)]
    place, latest = [], {}
    for number, (granule, i, page) in enumerate(rest):  # pages without an end of their own stay behind those before them
        latest[i] = granule if granule != NO_GRANULE else latest.get(i, 0)
        place.append((latest[i], number, page))
    return b"".join(out + [page for _, _, page in sorted(place, key=lambda x: x[:2])])


def payload_of(text: bytes, multiple: int) -> bytes:
    """Padded with blanks to a positive multiple."""
    return text.ljust(max(multiple, -(-len(text) // multiple) * multiple), b" ")


def media_of(payload: bytes, n_bytes: int, rate: int = 8000, packet: int = 4096) -> bytes:
    """Samples in packets of ``packet`` bytes, timed by their granule positions, beside a stream with ``n_bytes``."""
    samples = [(_SAMPLES_HEAD.pack(SAMPLE_CODEC, rate, 8), 0)]
    samples += [(payload[a : a + packet], min(len(payload), a + packet)) for a in range(0, len(payload), packet)]
    notes = [(_NOTES_HEAD.pack(NOTE_CODEC, rate), 0), (struct.pack("<Q", n_bytes), 0)]
    return multiplex({SAMPLES: samples, NOTES: notes})


def features(media: Media) -> tuple[bytes, int, str]:
    """Payload, unpadded length and a line of features of what ``media_of`` stored."""
    samples, notes = media.streams[SAMPLES], media.streams[NOTES]
    codec, rate, _ = _SAMPLES_HEAD.unpack(samples.packets[0].data)
    if codec != SAMPLE_CODEC or media.bad_pages or samples.lost or samples.torn:
        raise ValueError("not whole, or not of this kind")
    payload = b"".join(p.data for p in samples.packets[1:])
    (n_bytes,) = struct.unpack("<Q", notes.packets[1].data)
    wave = np.frombuffer(payload, np.uint8).astype(np.int32) - 128
    crossings = int(np.count_nonzero(np.signbit(wave[1:]) != np.signbit(wave[:-1])))
    energy = int((wave.astype(np.int64) ** 2).sum())
    line = f"streams={len(media.streams)};pages={media.pages};packets={len(samples.packets) - 1};rate={rate};ms={samples.granule * 1000 // rate};peak={int(np.abs(wave).max())};power={energy // len(wave)};crossings={crossings}"
    return payload, n_bytes, line


def store_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", multiple: int = 192, rate: int = 8000, packet: int = 4096) -> DataFrame:
    """(key, n_bytes, media): each text as an Ogg file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                raws = [x.as_buffer().to_pybytes() for x in part.column(1)]
                media = [media_of(payload_of(raw, multiple), len(raw), rate, packet) for raw in raws]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(map(len, raws)), pa.int64()), pa.array(media, pa.binary())], [key, "n_bytes", "media"])

    return docs.select(F.col(key).cast("long").alias(key), text_or_empty(text).cast("binary").alias("text")).mapInArrow(run, f"`{key}` bigint, n_bytes bigint, media binary")


def read_texts(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """(key, n_bytes, media, payload, feature), all but the key read from the stored bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [features(demultiplex(x.as_buffer().to_pybytes())) for x in part.column(1)]
                payload, n_bytes, line = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_bytes, pa.int64()), part.column(1), pa.array(payload, pa.binary()), pa.array(line)], [key, "n_bytes", "media", "payload", "feature"])

    return media.select(key, F.col(column).alias("media")).mapInArrow(run, f"`{key}` bigint, n_bytes bigint, media binary, payload binary, feature string")


def probe(media: DataFrame, key: str, column: str = "media", rate: int = 8000) -> DataFrame:
    """One row per logical stream of any Ogg column, damaged ones too; null and non-Ogg values give no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, "serial", "pages", "packets", "bytes", "granule", "seconds", "lost_pages", "torn_packets", "bad_pages", "skipped_bytes"]
        for batch in batches:
            rows = []
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = demultiplex(x.as_py() or b"")
                rows += [(k, s.serial, s.pages, len(s.packets), sum(len(p.data) for p in s.packets), s.granule, s.seconds(rate), s.lost, s.torn, found.bad_pages, found.skipped) for s in found.streams.values()]
            if rows:
                kinds = [batch.column(0).type, *[pa.int64()] * 5, pa.float64(), *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    kind = media.schema[key].dataType.simpleString()
    return media.select(key, column).mapInArrow(run, f"`{key}` {kind}, serial bigint, pages bigint, packets bigint, bytes bigint, granule bigint, seconds double, lost_pages bigint, torn_packets bigint, bad_pages bigint, skipped_bytes bigint")
