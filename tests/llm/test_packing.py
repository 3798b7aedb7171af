import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from engrama.llm import packing
from engrama.llm.tokens import WordCachedEncoder, vocabulary_path

from .helpers import corpus, docs_of, with_odd_keys


def whole(texts):
    t = Tokenizer.from_file(vocabulary_path())
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


ODD = ["", None, "a  b\n\nc", "x ́é é", "<|endoftext|> hi<|startoftext|>x,. <|EndOfText|>", "don't we'll 'tis' it'S 12. 1,2,", "İstanbul ΣΑΣ ß\tq\r\nz \x1c w k", "a,b .. c.", "é. THE,. x-y. ÀÉ. ÿ µ", "́, a", "w" * 500 + " z"]


def test_encoder_equals_the_library():
    texts = ODD + corpus()
    for cap in (8, 100_000):
        found = WordCachedEncoder(vocabulary_path(), max_entries=cap).encode(texts)
        assert [np.frombuffer(x, "<u4").tolist() for x in found] == whole(texts)


def check_plan(histogram, capacity):
    plan = packing.best_two_fit(histogram, capacity)
    bins = {}
    for size, n in histogram.items():
        if n:
            b, o = plan.place(np.full(n, size), np.arange(n))
            for x, y in zip(b.tolist(), o.tolist(), strict=True):
                bins.setdefault(x, []).append((y, size))
    assert sorted(bins) == list(range(plan.bins))
    for b in bins.values():
        at = 0
        for offset, size in sorted(b):
            assert offset == at
            at += size
        assert at <= capacity
    return plan.bins


def test_plan_is_gapless_and_close_to_the_bound():
    rng = random.Random(3)
    for capacity in (10, 64, 2048):
        for _ in range(15):
            histogram = {}
            for _ in range(rng.randrange(1, 200)):
                s = rng.randrange(1, capacity + 1)
                histogram[s] = histogram.get(s, 0) + rng.randrange(1, 5)
            bound = -(-sum(s * n for s, n in histogram.items()) // capacity)
            big = sum(n for s, n in histogram.items() if 2 * s > capacity)
            assert max(bound, big) <= check_plan(histogram, capacity) <= 1.25 * max(bound, big) + 1


def test_two_fit_beats_greedy():
    # greedy puts 6+3 in a bin of 10; 6+2+2 fills it
    assert check_plan({6: 1, 3: 1, 2: 2, 7: 1}, 10) == 2
    assert packing.best_two_fit({}, 10).bins == 0
    with pytest.raises(ValueError):
        packing.best_two_fit({11: 1}, 10)


def test_pack_documents(spark):
    texts = corpus()
    out = packing.pack_documents(docs_of(spark, texts), 64).collect()
    ids = [x + [0] for x in whole(texts)]
    want = {}
    for i, x in enumerate(ids):
        for p, a in enumerate(range(0, len(x), 64)):
            part = x[a : a + 64]
            want[i, p] = (a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in out} == want
    bins = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 64
    assert len(bins) <= -(-sum(map(len, ids)) // 64) * 1.05 + 1


def test_sequences_hold_the_ids(spark):
    docs = docs_of(spark, ["a b c", "d", None, "e f g h i j k l m n o p"])
    pieces = packing.tokenize_pieces(docs, 8)
    placed = packing.pack_documents(docs, 8)
    by = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in packing.sequences(placed, pieces).collect()}
    raw = {(r["doc_id"], r["piece"]): np.frombuffer(r["ids"], "<u4").tolist() for r in pieces.collect()}
    for r in placed.collect():
        assert by[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == raw[r["doc_id"], r["piece"]]


def test_odd_rows_and_empty(spark):
    docs = with_odd_keys(spark, corpus(n=5))
    out = packing.pack_documents(docs, 128)
    rows = out.collect()
    assert len([r for r in rows if r["piece"] == 0]) == docs.count()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    assert packing.pack_documents(docs.limit(0), 128).collect() == []


def brute_best_two_fit(lengths, capacity):
    """One bin after the other: greedily, longest first; then the smallest gives way to the two that fill its gap best."""
    left, bins = sorted(lengths, reverse=True), []
    while left:
        bin_, rest, room = [], [], capacity
        for n in left:
            if n <= room:
                bin_.append(n)
                room -= n
            else:
                rest.append(n)
        if room and len(bin_) > 1:
            smallest = min(bin_)
            pairs = [(-(a + b), min(a, b), max(a, b)) for i, a in enumerate(rest) for b in rest[i + 1 :] if smallest < a + b <= room + smallest]
            if pairs:
                _, a, b = min(pairs)
                bin_.remove(smallest)
                for n in (a, b):
                    bin_.append(n)
                    rest.remove(n)
                rest.append(smallest)
        bins.append(sorted(bin_))
        left = sorted(rest, reverse=True)
    return sorted(bins)


def test_plan_equals_bin_by_bin_filling():
    rng = random.Random(17)
    for capacity in (7, 20, 100):
        for _ in range(25):
            lengths = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 50))] + [rng.randrange(1, capacity + 1)] * rng.randrange(0, 40)
            histogram = {n: lengths.count(n) for n in set(lengths)}
            plan = packing.best_two_fit(histogram, capacity)
            bins = {}
            for n, k in histogram.items():
                for b in plan.place(np.full(k, n), np.arange(k))[0].tolist():
                    bins.setdefault(b, []).append(n)
            assert sorted(map(sorted, bins.values())) == brute_best_two_fit(lengths, capacity)


def test_clashing_names(spark):
    names = ["__salt", "__rank", "__n", "__before"]
    pieces = spark.createDataFrame([(i, 0, 3 + i % 4, *range(4)) for i in range(30)], "doc_id long, piece int, length long, " + ", ".join(f"{n} long" for n in names))
    out = packing.pack(pieces, 10)
    assert out.columns == [*pieces.columns, "sequence_id", "offset"] and out.count() == 30
