import os
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as driver
import corpus_pipeline
from engrama.llm.queries import RATE, ROUNDS, TARGETS
from engrama.llm.tokens import vocabulary_path

from .helpers import docs_of, with_odd_keys
from .test_linededup import brute as dedup
from .test_mixing import brute_rake
from .test_quality import brute_base, brute_kept, prose
from .test_simhash import brute_classes, brute_print


def made():
    rng = random.Random(11)
    texts = [prose(rng, rng.randrange(60, 300)) for _ in range(60)]
    texts += [texts[i] for i in range(0, 20)]
    texts += ["a shared line that many hold\n" + prose(rng, 80) for _ in range(10)]
    return [*texts, None, "", "too short", "###$$$ " * 100, prose(rng, 5000)]


def test_against_brute_force(spark, tmp_path):
    texts = made()
    docs = docs_of(spark, texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc_id"], r["piece"]): (r["length"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    meta = {r["doc_id"]: (r["source"] or "(none)", r["lang"] or "(none)") for r in docs.collect()}
    rows = {}
    for i, t in enumerate(texts):
        kept = brute_kept(t, docs_lang(i))
        assert not (kept and brute_base(t)[-1])
        if kept:
            rows[i] = t
    rows = {i: t if "\n" not in (texts[i] or "") and t == texts[i] else t for i, t in dedup(sorted(rows.items())).items()}
    ids = sorted(rows)
    labels = brute_classes([brute_print(rows[i]) for i in ids])
    rows = {i: rows[i] for n, i in enumerate(ids) if labels[n] == n}
    topic = lambda t: "prose"  # noqa: E731  none of these texts has another
    cells = {}
    for i, t in rows.items():
        c = (*meta[i], topic(t))
        cells[c] = cells.get(c, 0) + len(t.split())
    p = brute_rake(cells, [TARGETS[d] for d in ("source", "lang", "topic")], RATE, ROUNDS)[0]
    import hashlib

    u = lambda i: int(hashlib.md5(f"{i}:7".encode()).hexdigest()[:13], 16) / 2**52
    rows = {i: t for i, t in rows.items() if u(i) < p[(*meta[i], topic(t))]}
    want = {}
    t = Tokenizer.from_file(vocabulary_path())
    for i, x in rows.items():
        whole = [*t.encode(x, add_special_tokens=False).ids, 0]
        for n, a in enumerate(range(0, len(whole), 2048)):
            part = whole[a : a + 2048]
            want[i, n] = (len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert got == want and len(want) > 20


def docs_lang(i):
    return ["en", "de", None, "xx"][i % 4]


def test_stages_keep_columns(spark):
    docs = with_odd_keys(spark, made()[:20])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns, name
        assert stage(spark, docs.limit(0), "").collect() == [], name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), "").collect() == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
@pytest.mark.parametrize("name", [n for n in driver.queries() if n[:2] == "op" and n[2].isdigit()])
def test_queries_run(spark, name):
    table = "pages" if name in ("op2_url_filter", "op6_html") else "documents"
    n = spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").count()
    df = driver.queries()[name](spark, "/root/testdata/sf0.001")
    assert df.count() >= n if name == "op1_packing" else df.count() == n


