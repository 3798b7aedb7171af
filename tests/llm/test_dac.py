import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from engrama.llm import dac
from engrama.llm.tokens import vocabulary_path

from .helpers import corpus, docs_of, with_odd_keys


@pytest.mark.parametrize("width", [8, 16])
def test_random_access(width):
    rng = np.random.default_rng(1)
    for ids in (np.zeros(0, "<u4"), np.zeros(1, "<u4"), rng.integers(0, 50_000, 3000).astype("<u4"), rng.integers(0, 200, 1025).astype("<u4"), (2 ** rng.integers(0, 32, 2500)).astype("<u4"), np.full(600, 2**32 - 1, "<u4")):
        cuts = sorted(rng.integers(0, len(ids) + 1, 5).tolist())
        reader = dac.Reader(dac.to_bytes([3, 1, 4, 1, 5], [0, *cuts[:4]], ids, width))
        assert reader.slice(0, len(ids)).tolist() == ids.tolist()
        for i in rng.integers(0, max(1, len(ids)), 200).tolist() if len(ids) else []:
            assert reader[i] == ids[i]
        for a in range(0, len(ids), 97):
            b = int(rng.integers(a, len(ids) + 1))
            assert reader.slice(a, b).tolist() == ids[a:b].tolist()
        with pytest.raises(IndexError):
            reader[len(ids)]
        bounds = [0, *cuts[:4], len(ids)]
        for k in range(5):
            assert reader.document(k).tolist() == ids[bounds[k] : bounds[k + 1]].tolist()
    with pytest.raises(ValueError):
        dac.Reader(b"x" * 100)


def test_rank():
    rng = random.Random(2)
    flags = np.array([rng.random() < 0.3 for _ in range(5000)])
    bits = dac._padded(np.packbits(flags, bitorder="little"))
    directory = dac.rank_directory(bits)
    for i in range(0, 5000, 7):
        assert dac.Reader._rank(bits, directory, i) == int(flags[:i].sum())


def test_round_trip(spark):
    texts = corpus(n=30)
    t = Tokenizer.from_file(vocabulary_path())
    want, at = {}, 0
    for i, e in enumerate(t.encode_batch([x or "" for x in texts], add_special_tokens=False)):
        ids = [*e.ids, 1]
        want[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    for file_ids in (300, 4_000_000):
        manifest = dac.write(docs_of(spark, texts).repartition(5), file_ids=file_ids)
        got = dac.read(manifest).collect()
        assert {r["doc_id"]: (r["start"], r["n_tokens"], zlib.crc32(r["ids"])) for r in got} == want
        assert len(got) == len(texts)
        if file_ids == 300:
            assert manifest.count() > 4


def test_odd_rows(spark):
    docs = with_odd_keys(spark, corpus(n=5))
    got = dac.read(dac.write(docs)).collect()
    assert len(got) == docs.count()
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])][:2] == [None, None]
    spans = sorted((r["start"], r["n_tokens"]) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
    assert dac.read(dac.write(docs.limit(0))).collect() == []


def test_smallest_key_and_none(spark, tmp_path):
    docs = spark.createDataFrame([(-(2**63), "a b"), (None, "c"), (None, None), (0, "d")], "doc_id long, text string")
    got = dac.read(dac.write(docs, f"file://{tmp_path}/t")).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, None, -(2**63), 0]
