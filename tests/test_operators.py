import random
from math import exp, log

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from engrama.operators import aggregates, cells, filters, graph, ingest, knn, lexical, lifecycle, oplog, records
from engrama.operators.ranking import fuse, recency
from engrama.schema import MEMORY, NOW_MS


def memories(spark, rows):
    names = [f.name for f in MEMORY]
    base = {"kind": "episodic", "created_at": NOW_MS, "importance": 0.5, "tags": [], "sources": [], "entities": [], "visibility": "shared"}
    return spark.createDataFrame([tuple((base | r).get(n) for n in names) for r in rows], MEMORY)


def test_filters(spark):
    m = memories(spark, [{"id": "a", "tags": ["x", "y"], "session_id": "s"}, {"id": "b", "tags": ["x"], "kind": "semantic", "expires_at": NOW_MS}, {"id": "c", "agent_id": "p", "visibility": "private", "created_at": 5}, {"id": "d", "agent_id": "q", "visibility": "private"}])
    ids = lambda **c: "".join(sorted(r["id"] for r in filters.matching(m, **c).collect()))
    assert ids() == "abcd" and ids(kinds=["semantic"]) == "b" and ids(tags=["y", "x"]) == "a" and ids(tags=["x"]) == "ab"
    assert ids(session_id="s") == "a" and ids(agent_id="p") == "c" and ids(until=5) == "c" and ids(since=NOW_MS) == "abd"
    assert ids(now=NOW_MS) == "acd" and ids(as_agent="p") == "abc" and ids(as_agent="q", tags=["x"], now=NOW_MS) == "a"


def test_knn_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors, queries = rng.normal(size=(200, 8)).round(1), rng.normal(size=(7, 8)).round(1)
    corpus = spark.createDataFrame(pd.DataFrame({"id": [f"v{i:03d}" for i in range(200)], "embedding": vectors.tolist()})).unionByName(spark.createDataFrame([("odd", [1.0, 2.0]), ("none", None)], "id string, embedding array<double>"))
    asked = spark.createDataFrame([(i, q.tolist()) for i, q in enumerate(queries)] + [(99, None), (98, [1.0, 1.0])], "qid long, query_embedding array<double>")
    for block in (3, 4096):
        got = {}
        for r in knn.knn(asked, corpus.repartition(3), 5, block=block).orderBy("qid", "rank").collect():
            got.setdefault(r["qid"], []).append(r["id"])
        for i, q in enumerate(queries):
            s = np.round(vectors @ q, 9)
            assert got[i] == [f"v{j:03d}" for j in sorted(range(200), key=lambda j: (-s[j], j))[:5]]
        assert got[98] == ["odd"] and 99 not in got


def test_ann_recall(spark, tmp_path):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(20, 32))
    v = centers[rng.integers(0, 20, 1500)] + 0.15 * rng.normal(size=(1500, 32))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    corpus = spark.createDataFrame(pd.DataFrame({"id": range(1500), "embedding": v.tolist()}))
    asked = spark.createDataFrame([(i, v[i].tolist()) for i in range(0, 1500, 50)], "qid long, query_embedding array<double>")
    for mode, least in (("never", 0.9), ("always", 0.85)):
        cells.write_index(corpus, f"{tmp_path}/{mode}", 20, mode)
        ann = cells.search(asked, f"{tmp_path}/{mode}", 10, n_probe=4)
        assert aggregates.recall_at_k(ann, knn.knn(asked, corpus, 10)).first()["recall"] > least
    assert cells.quantizes("auto", 1024) and not cells.quantizes("auto", 384) and not cells.quantizes("never", 2048)
    assert cells.search(asked.limit(0), f"{tmp_path}/never", 10).collect() == []


def test_bounded_search_misses_nothing(spark, tmp_path):
    rng = np.random.default_rng(6)
    loose = rng.normal(size=(600, 16))
    centers = rng.normal(size=(6, 16))
    tight = centers[rng.integers(0, 6, 600)] + 0.05 * rng.normal(size=(600, 16))
    for name, v in (("loose", loose), ("tight", tight)):
        corpus = spark.createDataFrame(pd.DataFrame({"id": range(600), "embedding": v.astype(np.float32).astype(float).tolist()}))
        asked = spark.createDataFrame([(i, v[i].tolist()) for i in range(0, 600, 40)], "qid long, query_embedding array<double>")
        truth = knn.knn(asked, corpus, 10)
        recall = lambda got: aggregates.recall_at_k(got, truth).first()["recall"]  # noqa: E731, B023
        cells.write_index(corpus, f"{tmp_path}/{name}", 12, "never")
        assert recall(cells.search(asked, f"{tmp_path}/{name}", 10, n_probe=1, block=7, bounded=True)) == 1
        if name == "loose":
            assert recall(cells.search(asked, f"{tmp_path}/{name}", 10, n_probe=1)) < 0.9
            cells.write_index(corpus, f"{tmp_path}/codes", 12, "always")
            assert recall(cells.search(asked, f"{tmp_path}/codes", 10, n_probe=1, bounded=True)) >= 0.9


def test_index_of_mixed_lengths(spark, tmp_path):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(80, 8)).astype(np.float32).astype(float)
    rows = [(1000 + i, [1.0, 0.1 * i]) for i in range(12)] + [(2000, [2.0] * 5), (2001, None)] + [(i, x.tolist()) for i, x in enumerate(v)]
    corpus = spark.createDataFrame(rows, "id long, embedding array<double>").coalesce(1)
    asked = spark.createDataFrame([(i, v[i].tolist()) for i in range(5)] + [(98, [1.0, 1.0]), (97, [1.0] * 5), (96, [1.0] * 3), (95, None)], "qid long, query_embedding array<double>")
    cells.write_index(corpus, f"{tmp_path}/mixed", 4, "never")
    rows = lambda df: {(r["qid"], r["rank"]): r["id"] for r in df.collect()}
    got = rows(cells.search(asked, f"{tmp_path}/mixed", 5, n_probe=1, bounded=True))
    assert got == rows(knn.knn(asked, corpus, 5)) and got[98, 1] == 1011 and got[97, 1] == 2000 and {q for q, _ in got} == {0, 1, 2, 3, 4, 97, 98}


def test_index_filters_appends_and_removes(spark, tmp_path):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(300, 16)).astype(np.float32).astype(float)
    carried = "id long, embedding array<double>, kind string, tags array<string>, session_id string, agent_id string, created_at long, expires_at long, visibility string"
    rows = [(i, x.tolist(), ("semantic", "episodic")[i % 2], ["a", "b"][: i % 3], None, f"agent{i % 4}" if i % 5 else None, i, 50 if i % 7 == 0 else None, ("shared", "private")[i % 2]) for i, x in enumerate(v)]
    make = lambda some: spark.createDataFrame(some, carried)
    odd = (900, [1.0, 2.0], "semantic", [], None, None, 1, None, "shared")
    wants = [(i, v[i].tolist(), [None, ["semantic"]][i % 2], [None, ["a"]][i // 2 % 2], None, 100 if i % 3 == 0 else None, "agent1" if i % 2 else None) for i in range(12)]
    wants += [(98, [1.0, 1.0], None, None, None, None, None), (97, v[0].tolist(), ["none"], None, None, None, None)]
    asked = spark.createDataFrame(wants, "qid long, query_embedding array<double>, kinds array<string>, tags array<string>, session_id string, since long, as_agent string").withColumns({"agent_id": F.lit(None).cast("string"), "until": F.lit(None).cast("long")})
    ids = lambda some: spark.createDataFrame([(i,) for i in some], "id long")
    got = lambda df: {(r["qid"], r["rank"]): r["id"] for r in df.collect()}
    left = [r for r in rows if not (r[0] % 10 == 3 and r[0] >= 20)] + [odd]
    truth = knn.knn(asked, make(left), 10, now=60, filtered=True)
    for mode in ("never", "always"):
        path = f"{tmp_path}/{mode}"
        cells.write_index(make(rows[:200]), path, 6, mode, filtered=True)
        cells.remove(ids([*range(3, 300, 10), 12345]), path)  # rows yet to come are not meant
        cells.append(make([*rows[200:], odd, rows[3], rows[13]]), path)
        cells.remove(ids(range(203, 300, 10)), path)
        make(rows[20:30]).select("id", "embedding").write.parquet(f"{path}/rest/gen=9")  # left by a write that failed
        found = cells.search(asked, path, 10, n_probe=1, block=5, filtered=True, now=60)
        assert got(found) == got(truth) if mode == "never" else aggregates.recall_at_k(found, truth).first()["recall"] >= 0.95
        assert {r["id"] for r in found.collect()} <= {r[0] for r in left} and 97 not in {q for q, _ in got(found)}
        fewer = cells.search(asked, path, 10, n_probe=1, filtered=True, now=60, without=ids(range(0, 300, 2)))
        assert all(i % 2 for i in got(fewer).values() if i != 900)
    plain = f"{tmp_path}/plain"
    cells.write_index(make(rows), plain, 6, "always")
    whole = knn.knn(asked, make(rows), 10)
    by_codes, by_vectors = (aggregates.recall_at_k(cells.search(asked, plain, 10, bounded=True, rerank=n), whole).first()["recall"] for n in (0, 4))
    assert by_vectors == 1 >= by_codes
    with pytest.raises(ValueError):
        cells.search(asked, plain, 10, now=60)


def test_term_index_gives_the_same(spark, tmp_path):
    rng = random.Random(8)
    corpus = spark.createDataFrame([(f"d{i}", " ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(0, 30)))) for i in range(80)], "id string, text string")
    asked = spark.createDataFrame([(1, "w1 w2 w2 w59"), (2, "none"), (3, "w7")], "qid long, query string")
    lexical.write_index(corpus, str(tmp_path), 8)
    rows = lambda df: {(r["qid"], r["id"]): round(r["score"], 9) for r in df.collect()}
    assert rows(lexical.bm25_indexed(asked, str(tmp_path), 8)) == rows(lexical.bm25(asked, corpus))


def test_bm25_statistics_are_global(spark):
    docs = {"a": "red fox runs", "b": "red red dog", "c": "blue bird sings a song", "d": ""}
    corpus = spark.createDataFrame(list(docs.items()), "id string, text string")
    asked = spark.createDataFrame([(1, "red red fox"), (2, "nothing here"), (3, "")], "qid long, query string")
    tokens = {k: v.split() for k, v in docs.items()}
    avg = sum(map(len, tokens.values())) / 4

    def score(d):
        total = 0.0
        for t in "red red fox".split():
            df, tf = sum(t in x for x in tokens.values()), tokens[d].count(t)
            total += log((4 - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(tokens[d]) / avg))
        return total

    got = {(r["qid"], r["id"]): r["score"] for r in lexical.bm25(asked, corpus).collect()}
    assert got == {(1, "a"): pytest.approx(score("a")), (1, "b"): pytest.approx(score("b"))}
    only = lexical.bm25(asked, corpus, keep=lambda rows: rows.filter("id = 'b'")).collect()
    assert [(r["id"], r["score"]) for r in only] == [("b", pytest.approx(score("b")))]


def test_graph_against_brute_force(spark):
    rng = random.Random(4)
    made = {f"m{i}": rng.sample([f"e{j}" for j in range(12)], rng.randrange(0, 6)) for i in range(40)}
    m = memories(spark, [{"id": k, "entities": v} for k, v in made.items()])
    df, edge = {}, {}
    for v in made.values():
        for a in v:
            df[a] = df.get(a, 0) + 1
            for b in v:
                if a != b:
                    edge[a, b] = edge.get((a, b), 0) + 1
    assert {(r["src"], r["dst"]): r["cnt"] for r in graph.edges(m).collect()} == edge
    rare = lambda e: 1 / (1 + log(1 + df[e]))
    want = {}
    for q in ("e0", "e3", "e3"):
        if q == "e3" and ("seen", 0) in want:
            continue
        want["seen", 0] = 1
        near = sorted(((-c, b) for (a, b), c in edge.items() if a == q))[:5]
        for k, v in made.items():
            if q in v:
                want[k, 1] = want.get((k, 1), 0) + rare(q)
            for c, b in near:
                if b in v:
                    want[k, 1] = want.get((k, 1), 0) + 0.3 * rare(b) * log(1 - c)
        if q == "e0":
            del want["seen", 0]
    want.pop(("seen", 0), None)
    asked = spark.createDataFrame([(1, "e0"), (1, "e3"), (1, "e3"), (1, "unknown")], "qid long, entity string")
    got = {(r["id"], r["qid"]): r["score"] for r in graph.related(asked, m).collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_fusion_and_recency(spark):
    leg = lambda rows: spark.createDataFrame(rows, "qid long, id string, rank int")
    got = {r["id"]: (r["v"], r["l"]) for r in fuse({"v": leg([(1, "a", 1), (1, "b", 2)]), "l": leg([(1, "b", 1), (1, "c", 2)])}).collect()}
    assert got == {"a": (1 / 61, 0.0), "b": (1 / 62, 1 / 61), "c": (0.0, 1 / 62)}
    ages = spark.createDataFrame([(NOW_MS,), (NOW_MS + 5,), (NOW_MS - 604_800_000,)], "t long").select(recency(F.col("t"), NOW_MS)).collect()
    assert [r[0] for r in ages] == [1.0, 1.0, pytest.approx(0.5)]


def test_validation_and_defaults(spark):
    rows = spark.createDataFrame([("ok", None, None), ("  ", None, None), ("x", 0, None), ("x", -1, None), ("x", 1_785_306_704, None), ("x", None, [1.0])], "text string, created_at long, embedding array<double>")
    found = [r["problem"] for r in records.validated(rows, 2).collect()]
    assert found[0] is None and found[1] == "text is empty" and found[2] == found[3] == "created_at must be positive"
    assert found[4].endswith("1785306704000") and found[5] == "embedding must have 2 dimensions"
    r = spark.createDataFrame([("w", "working", NOW_MS - 3 * 86_400_000, None, None, 7.0), ("t", None, NOW_MS - 3_600_000, 1800, "me", None)], "text string, kind string, created_at long, ttl_seconds long, agent_id string, importance double")
    w, t = records.build(r, NOW_MS).orderBy(F.desc("text")).collect()
    assert (w["expires_at"], w["visibility"], w["importance"]) == (NOW_MS - 2 * 86_400_000, "shared", 1.0)
    assert (t["expires_at"], t["visibility"], t["importance"], t["kind"]) == (NOW_MS - 1_800_000, "private", 0.5, "episodic")
    assert w["id"] != t["id"] and w["id"] == records.build(r, NOW_MS).filter("text = 'w'").first()["id"]


def test_fold(spark):
    def op(seq, kind, i, text=None, sources=None):
        record = tuple({"id": i, "text": text, "sources": sources or []}.get(f.name) for f in MEMORY) if kind == "remember" else None
        return (seq, kind, i, record, sources if kind == "set_sources" else None)

    ops = [op(1, "remember", "a", "A"), op(2, "remember", "a", "again"), op(3, "set_sources", "a", sources=["x"]), op(1, "remember", "b", "B"), op(4, "forget", "b"), op(5, "remember", "b", "B2", ["s"]), op(1, "remember", "c", "C"), op(2, "forget", "c"), op(3, "set_sources", "c", sources=["y"]), op(9, "forget", "zz"), op(9, "set_sources", "zz", sources=["q"])]
    got = {r["id"]: (r["text"], r["sources"]) for r in oplog.fold(spark.createDataFrame(ops, oplog.OPLOG)).collect()}
    assert got == {"a": ("A", ["x"]), "b": ("B2", ["s"])}


def test_summary():
    lines = ["api latency rose after the deploy.", "latency of the api is high", "birthday cake on friday", "deploy raised api latency;"]
    s = lifecycle.summarize(lines, 80)
    assert "latency" in s and "birthday" not in s
    assert lifecycle.summarize(["x" * 900], 500) == "x" * 900
    with pytest.raises(ValueError):
        lifecycle.summarize([])


def test_batches(spark):
    rows = [{"id": f"m{i:02d}", "session_id": "a", "created_at": 1000 + i} for i in range(29)] + [{"id": f"n{i}", "created_at": i} for i in range(4)] + [{"id": "z", "session_id": "b"}]
    got = lifecycle.batches(memories(spark, rows)).collect()
    sizes = {}
    for r in got:
        sizes[r["session_id"], r["batch"]] = sizes.get((r["session_id"], r["batch"]), 0) + 1
    assert sizes == {("a", 0): 12, ("a", 1): 12, ("a", 2): 5, (None, 0): 4}


def test_candidates():
    assert [c["text"] for c in ingest.parse_candidates('Sure:\n```json\n[{"text": " a "}, 5, {"x": 1}, {"text": "b", "kind": "odd", "importance": 9}]\n```')] == ["a", "b"]
    assert len(ingest.parse_candidates("[" + ",".join('{"text": "f"}' for _ in range(50)) + "]", 5)) == 5
    with pytest.raises(ValueError):
        ingest.parse_candidates("no facts")
    assert ingest.parse_indices("[1, 3, 99, 0]", 3) == [0, 2]


def test_greedy_distinct(spark):
    rows = spark.createDataFrame([("e", 0, [1.0, 0.0]), ("e", 1, [0.96, 0.28]), ("e", 2, [0.8, 0.6]), ("f", 0, [1.0, 0.0])], "exchange string, place int, embedding array<double>")
    got = sorted((r["exchange"], r["place"]) for r in ingest.greedy_distinct(rows, 0.95).collect())
    assert got == [("e", 0), ("e", 2), ("f", 0)]


def test_histogram(spark):
    rows = spark.createDataFrame([("r", 0.0004), ("r", 0.03)], "route string, s double")
    h = {r["le"]: (r["cnt"], r["total"], r["sum_seconds"]) for r in aggregates.latency_histogram(rows, F.col("s"), "route").collect()}
    assert h["0.0005"][0] == 1 and h["+Inf"] == (2, 2, pytest.approx(0.0304)) and h["5.0"][0] == 2


def test_recency_constant():
    assert exp(-log(2)) == pytest.approx(0.5)
