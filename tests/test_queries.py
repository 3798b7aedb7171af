"""Every query against DuckDB on the smallest test data."""

import hashlib
import os
import re

import duckdb
import numpy as np
import pytest

import __spark_entry__ as driver
from engrama.operators import aggregates

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")
CORE = [n for n in driver.queries() if not (n[:2] == "op" and n[2].isdigit()) and n != "pipeline"]


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(DIR):
        con.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{DIR}/{t}'")
    return con


@pytest.mark.parametrize("name", CORE)
def test_query(spark, duck, name):
    df = driver.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in driver.oracle_sql():
        assert got
        return
    want = duck.sql(driver.oracle_sql()[name])
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
@pytest.mark.parametrize("name", ["knn_ann", "knn_ann_sq8"])
def test_indexed_recall(spark, name, size):
    d = f"/root/testdata/{size}"
    truth = driver.queries()["knn_exact"](spark, d)
    assert aggregates.recall_at_k(driver.queries()[name](spark, d), truth, key="vec_id").first()["recall"] >= 0.9


def test_dedup_existing_searches_every_label(spark, tmp_path):
    """Candidates 0, 50, ..., 550: one near a row of each label, one near none, one without any vector."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=(600, 64))
    for label in range(10):
        v[50 * label + 10 + label] = v[50 * label] + 0.1 * rng.normal(size=64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i, v[i].tolist() if i != 550 else None, i % 10) for i in range(600)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    s = np.array([x if x is not None else [0.0] * 64 for _, x, _ in rows])
    s = s[::50] @ s.T
    s[range(12), range(0, 600, 50)] = -1
    assert sorted(np.flatnonzero(s.max(axis=1) >= 0.8)) == list(range(10))
    assert [r["qid"] for r in driver.queries()["dedup_existing"](spark, str(tmp_path)).orderBy("qid").collect()] == [500, 550]


def test_embedder_and_prefixes_over_documents(spark, tmp_path):
    texts = [None, "", " .. ", "one", "Über den Fluß", "some words again", "some words again", "lorem ipsum dolor " * 3000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for i, text in enumerate(texts):
        words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
        parts = [(w, 1.0) for w in words] + [("#" + w[j : j + 3], 0.4) for w in words if len(w) > 3 for j in range(len(w) - 2)] + [(f"{a}_{b}", 0.7) for a, b in zip(words, words[1:])]
        v = np.zeros(256)
        for part, weight in parts:
            digest = hashlib.md5(part.encode()).hexdigest()
            v[int(digest[:8], 16) % 256] += weight if digest[8] < "8" else -weight
        want |= {(i, j): pytest.approx(x, abs=2e-6) for j, x in enumerate(v / (np.linalg.norm(v) or 1)) if round(x, 6)}
    assert {(r["doc_id"], r["pos"]): r["x"] for r in driver.queries()["hash_embed_documents"](spark, str(tmp_path)).collect()} == want
    got = {r["doc_id"]: (r["as_query"], r["as_passage"]) for r in driver.queries()["prefixing_documents"](spark, str(tmp_path)).collect()}
    assert got == {i: (None, None) if x is None else (f"query: {x}", f"passage: {x}") for i, x in enumerate(texts)}


def test_entry(spark):
    assert driver.entry(spark).count() > 0
