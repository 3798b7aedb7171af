import hashlib
import random
import zlib

import pytest

from engrama.llm import ogg, queries

from .helpers import corpus, docs_of, with_odd_keys


def slow_checksum(data):
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def test_checksum():
    rng = random.Random(1)
    for n in (0, 1, 5, 300):
        data = rng.randbytes(n)
        assert ogg.checksum(data) == slow_checksum(data)


def streams():
    rng = random.Random(2)
    sizes = [0, 1, 254, 255, 256, 510, 65_025, 65_026, 200_000, 3]
    return {7: [(b"head7", 0)] + [(rng.randbytes(n), 100 * i) for i, n in enumerate(sizes, 1)], 9: [(b"head9", 0)] + [(rng.randbytes(40), 90 * i) for i in range(1, 30)]}


def test_round_trip_of_many_streams():
    made = streams()
    found = ogg.demultiplex(ogg.multiplex(made))
    assert not found.bad_pages and not found.skipped
    for serial, packets in made.items():
        s = found.streams[serial]
        assert [p.data for p in s.packets] == [p for p, _ in packets]
        assert s.granule == packets[-1][1] and not s.lost and not s.torn and s.ended
        assert s.seconds(100) == packets[-1][1] / 100


def test_damage_is_found_and_passed():
    made = streams()
    raw = ogg.multiplex(made)
    at = raw.find(b"OggS", len(raw) // 3)
    bad = raw[: at + 60] + bytes([raw[at + 60] ^ 1]) + raw[at + 61 :]
    found = ogg.demultiplex(b"junk" + bad[:-5])
    assert found.bad_pages >= 1 and found.skipped >= 4
    assert sum(s.lost + s.torn for s in found.streams.values()) >= 1
    good = {serial: {p for p, _ in packets} for serial, packets in made.items()}
    assert all(p.data in good[s.serial] for s in found.streams.values() for p in s.packets)
    for junk in (b"", b"OggS", b"OggS" * 50, bytes(1000)):
        assert ogg.demultiplex(junk).streams == {}


def test_query(spark, tmp_path):
    texts = corpus(n=20) + ["x" * 192, "x" * 193, "é" * 96]
    docs_of(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for r in queries.op10_ogg(spark, str(tmp_path)).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        padded = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(padded))
        assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(padded[-16:])
        media = ogg.media_of(padded, len(raw))
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        assert f"ms={len(padded) * 1000 // 8000};" in r["feature"]
        assert seen.setdefault(raw, tuple(r)[1:]) == tuple(r)[1:]


def test_probe_and_odd_rows(spark):
    docs = with_odd_keys(spark, corpus(n=3))
    stored = ogg.store_texts(docs)
    assert stored.count() == docs.count()
    rows = ogg.probe(stored, "doc_id").collect()
    assert len(rows) == 2 * docs.count() and all(r["bad_pages"] == 0 for r in rows)
    odd = spark.createDataFrame([(1, None), (2, b"no ogg")], "doc_id long, media binary")
    assert ogg.probe(odd, "doc_id").collect() == []
    assert ogg.read_texts(ogg.store_texts(docs.limit(0))).collect() == []
    with pytest.raises(KeyError):
        ogg.features(ogg.demultiplex(b""))
