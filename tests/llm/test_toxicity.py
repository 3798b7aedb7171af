import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from engrama.llm import toxicity

from .helpers import corpus, docs_of, with_odd_keys


def test_machine_equals_pairs():
    rng = np.random.default_rng(2)
    m = toxicity.Machine(0.3, rng.normal(size=6), rng.normal(size=(6, 3)), {}, 10)
    for row in ([], [1], [0, 2, 5], [0, 1, 2, 3, 4, 5]):
        pairs = sum(m.factors[a] @ m.factors[b] for i, a in enumerate(row) for b in row[i + 1 :])
        assert m.raw([row])[0] == pytest.approx(0.3 + m.weights[row].sum() + pairs)


def test_learns_interactions():
    rows = [[0], [1], [0, 1], []] * 200
    y = np.array([0, 0, 1, 0] * 200, float)
    m = toxicity.train(rows, y, {i: i for i in range(2)}, 10, epochs=60)
    s = m.score([[0], [1], [0, 1], []])
    assert s[2] > 0.7 and max(s[0], s[1], s[3]) < 0.3


def test_held_out(spark):
    rng = random.Random(5)
    texts, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        words = [f"word{rng.randrange(300)}" for _ in range(rng.randrange(20, 200))]
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot,", "Moron", "loweix", "loweiy" + str(rng.randrange(20))]))
        texts.append(" ".join(words))
        labels.append((i, int(toxic)))
    docs = docs_of(spark, [*texts, None, ""])
    labelled = spark.createDataFrame([*labels, (None, 1), (5, None), (9999, 1)], "doc_id long, toxic int")
    train = labelled.filter("doc_id % 3 <> 1")
    model = toxicity.fit(docs, train)
    again = toxicity.fit(docs.repartition(7), train.repartition(3))
    assert np.array_equal(model.weights, again.weights) and model.chosen == again.chosen
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    held = [(scores[i] >= 0.7, bool(y)) for i, y in labels if i % 3 == 1]
    assert sum(a and b for a, b in held) / sum(b for _, b in held) > 0.9
    assert not any(a and not b for a, b in held)
    assert scores[400] == scores[401] < 0.5


def test_odd_cases(spark):
    docs = with_odd_keys(spark, corpus(n=4))
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, none)
    out = toxicity.score(docs, model).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 0.5 for r in out)
    one = toxicity.fit(docs, none.unionByName(spark.createDataFrame([(0, 1)], "doc_id long, toxic int")))
    assert toxicity.score(docs, one).agg(F.max("score")).first()[0] <= 0.5
    assert toxicity.score(docs.limit(0), model).collect() == []


def test_small_cache_loses_no_term():
    text = " ".join(f"wörd{i % 40}y" for i in range(300))
    whole, small = toxicity._Terms(1 << 12), toxicity._Terms(1 << 12, most=3)
    want = sorted({t for w in toxicity.words_of(text) for t in toxicity.terms_of(w, 1 << 12)})
    assert whole.of(text).tolist() == want
    for t in ("wörd1y wörd2y", text, text[: len(text) // 2], text):
        assert small.of(t).tolist() == whole.of(t).tolist() and len(small.cache) <= 3
    chosen = {t: i for i, t in enumerate(want[::2])}
    assert toxicity._Terms(1 << 12, chosen, most=3).of(text).tolist() == list(range(len(chosen)))


def test_a_pair_alone_tells_the_classes_apart(spark):
    """A label that is one word or the other, but not both: neither word has any weight of its own."""
    rng = random.Random(11)
    texts, labels = [], []
    for i in range(2400):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = [f"n{rng.randrange(150)}" for _ in range(12)] + ["group"] * a + ["slur"] * b
        rng.shuffle(words)
        texts.append(" ".join(words))
        labels.append((i, int(a != b)))
    labelled = spark.createDataFrame(labels, "doc_id long, toxic int")
    docs = docs_of(spark, texts)
    model = toxicity.fit(docs, labelled.filter("doc_id % 3 <> 1"))
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    held = [(scores[i] >= 0.5) == bool(y) for i, y in labels if i % 3 == 1]
    assert sum(held) / len(held) > 0.85


def test_query(spark, tmp_path):
    """The split, the cut and each score against the sum over all pairs; a text of a million words is scored whole."""
    import zlib

    from engrama.llm import queries

    rng = random.Random(7)
    texts = [" ".join(rng.choice(["fine", "good", "calm", "rude", "vile"]) if i % 2 else f"w{rng.randrange(30)}" for _ in range(30)) for i in range(200)]
    texts += [None, "", "w1 " * 1_000_000 + "rude vile " + " ".join(f"z{i}" for i in range(50_000))]
    labels = [(i, i % 2, 1) for i in range(200)]
    docs_of(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    out = {r["doc_id"]: r for r in queries.op3_toxicity(spark, str(tmp_path)).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(len(texts))}
    model = toxicity.fit(docs_of(spark, texts), spark.createDataFrame([x[:2] for x in labels if not held[x[0]]], "doc_id long, toxic int"))
    for i, t in enumerate(texts):
        found = {model.chosen[h] for w in toxicity.words_of(t or "") for h in toxicity.terms_of(w, model.buckets) if h in model.chosen}
        raw = model.bias + sum(model.weights[a] for a in found) + sum(float(model.factors[a] @ model.factors[b]) for a in found for b in found if a < b)
        want = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
        assert out[i]["held_out"] == held[i] and out[i]["score"] == pytest.approx(want) and out[i]["predicted"] == int(out[i]["score"] >= 0.7)
    assert len(out) == len(texts)
