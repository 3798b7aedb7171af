import io
import json
import logging
import threading
import urllib.error
import urllib.request
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from engrama.api import Config, Engine, Plugins, routes
from engrama.metrics import Metrics, log_request
from engrama.operators import oplog
from engrama.plugins import chat_client, chat_extractor, chat_reranker, chat_superseder, content_client, dimension_of, embedding_column, embeddings_client, keyword_reranker, parse_scores
from engrama.server import serve, stdio
from engrama.sources.store import read_json_log, read_snapshot, write_snapshot
from engrama.streaming.feeds import remember_stream, request_rates, request_stream
from engrama.tenancy import ApiKey, Auth, BadRequest, Forbidden, Registry, Unauthorized, validate

NOW = 1_706_659_200_000
DAY = 86_400_000


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/c", clock=lambda: NOW)


def texts(df):
    return [r["text"] for r in df.orderBy("rank").collect()]


def test_round_trip_and_restart(spark, tmp_path, engine):
    one = engine.remember(text="Dana filed INC-90312", tags=["oncall"], session_id="alpha")
    engine.remember_batch([{"text": f"status update {i}", "session_id": "beta"} for i in range(20)])
    assert one["entities"] == ["oncall", "inc-90312"]
    assert texts(engine.recall([{"query": "INC-90312", "strategy": "lexical", "top_k": 1}])) == ["Dana filed INC-90312"]
    engine.checkpoint()
    engine.remember(text="after the checkpoint")
    again = Engine(spark, f"file://{tmp_path}/c", clock=lambda: NOW)
    assert again.live().count() == 22 and again.get(one["id"])["text"] == one["text"]
    assert engine.forget(one["id"]) and not engine.forget(one["id"])
    assert again.live().count() == 21
    again.compact()
    assert engine.live().count() == 21 and engine.get(one["id"]) is None
    s = engine.stats()
    assert s["total_memories"] == 21 and s["vector_dim"] == 256 and s["wal_tail_ops"] == 0 and not s["quantized"]
    hits = engine.recall([{"query": "status", "session_id": "beta", "top_k": 5}])
    assert hits.count() == 5 and {r["session_id"] for r in hits.collect()} == {"beta"} and "embedding" not in hits.columns


def test_selective_filter_finds_all(engine):
    engine.remember_batch([{"text": f"report number {i}", "session_id": "big"} for i in range(300)] + [{"text": f"report part {i}", "session_id": "small"} for i in range(5)])
    hits = engine.recall([{"query": "report number 7", "session_id": "small", "top_k": 5}])
    assert hits.count() == 5 and {r["session_id"] for r in hits.collect()} == {"small"}


def test_recall_by_index(engine):
    v = np.random.default_rng(3).normal(size=(160, 16)).tolist()
    batch = lambda first, n: [{"text": f"report number {i} of team {i % 5}", "session_id": f"s{i % 3}", "embedding": v[i]} for i in range(first, first + n)]
    engine.remember_batch(batch(0, 150))
    asked = [{"query": "", "top_k": 20, "strategy": "semantic", "query_embedding": v[7]}, {"query": "team 3", "session_id": "s1", "top_k": 20, "query_embedding": v[155]}]
    found = lambda: sorted((r["qid"], r["rank"], r["id"], round(r["score"], 9)) for r in engine.recall(asked).collect())

    def same():
        by_index, leg = found(), engine._indexed_leg
        assert engine._indexed_leg() is not None
        engine._indexed_leg = lambda: None
        try:
            assert by_index == found()
        finally:
            engine._indexed_leg = leg
        return {i for _, _, i, _ in by_index}

    engine.build_index(cells=6, mode="never")
    engine.remember_batch(batch(150, 10))
    first = engine.live().filter("text LIKE 'report number 7 %'").first()["id"]
    assert engine.forget(first)
    assert first not in same()
    engine.checkpoint()
    assert engine.store.manifest()["indexed"] == engine.store.manifest()["tail"]
    same()
    engine.store.append(oplog.forget_ops(engine.live().limit(1).select("id"), engine.store.manifest()["next"]))
    engine.store.checkpoint()  # behind the engine's back: the index has not seen it
    assert engine._indexed_leg() is None


def test_one_hop(engine):
    engine.remember_batch([{"text": "we moved Project Phoenix under the Billing Team"}, {"text": "now Dana Whitfield leads Project Phoenix"}, {"text": "rate limits of the Billing Team were raised"}] + [{"text": f"lunch menu {i} has soup"} for i in range(20)])
    hits = engine.recall([{"query": "what does Dana Whitfield do", "strategy": "relational", "top_k": 3}]).collect()
    assert len(hits) == 3 and max(h["graph"] for h in hits) > 0
    assert any("Phoenix" in h["text"] for h in hits)


def test_rerank_and_opt_out(spark, tmp_path):
    def scorer(query, docs):
        return [1.0 if "magic" in d else 0.0 for d in docs]

    e = Engine(spark, f"file://{tmp_path}/c", plugins=Plugins(reranker=scorer), clock=lambda: NOW)
    e.remember_batch([{"text": "latency is high"}, {"text": "latency is low"}, {"text": "latency by magic"}])
    first = e.recall([{"query": "latency is", "top_k": 3}]).orderBy("rank").collect()
    assert first[0]["text"] == "latency by magic" and first[0]["rerank"] == 1.0
    assert all(r["rerank"] == 0.0 for r in e.recall([{"query": "latency is", "top_k": 3}], rerank=False).collect())
    broken = Engine(spark, f"file://{tmp_path}/c", plugins=Plugins(reranker=lambda q, d: [1.0]), clock=lambda: NOW)
    plain = [r["id"] for r in e.recall([{"query": "latency is"}], rerank=False).orderBy("rank").collect()]
    assert [r["id"] for r in broken.recall([{"query": "latency is"}]).orderBy("rank").collect()] == plain
    assert keyword_reranker("a b", ["b c", "a b", ""]) == [0.5, 1.0, 0.0]


def test_recency_ttl_and_units(engine):
    engine.remember(text="the deploy went fine", created_at=NOW - 60 * DAY)
    engine.remember(text="the deploy went fine today")
    got = {r["text"]: r["recency"] for r in engine.recall([{"query": "deploy", "strategy": "recent"}]).collect()}
    assert got["the deploy went fine"] < 0.05 < got["the deploy went fine today"]
    engine.remember(text="gone on arrival", created_at=NOW - 3_600_000, ttl_seconds=1800)
    assert "gone on arrival" not in texts(engine.recall([{"query": "gone on arrival"}]))
    for bad in (1_785_306_704, 0, -1):
        with pytest.raises(BadRequest):
            engine.remember(text="x", created_at=bad)
    with pytest.raises(BadRequest):
        engine.remember_batch([{"text": "good"}, {"text": " "}])
    with pytest.raises(BadRequest):
        engine.remember(text="wrong length", embedding=[1.0, 2.0])
    with pytest.raises(BadRequest):
        engine.remember(text="x", nonsense=1)
    assert engine.live().count() == 3


def test_query_of_another_length_has_no_vector_leg(engine):
    engine.remember(text="plain words")
    r = engine.recall([{"query": "plain", "query_embedding": [1.0, 0.0]}]).collect()
    assert len(r) == 1 and r[0]["vector"] == 0.0 and r[0]["lexical"] > 0


def test_visibility(engine):
    engine.remember(text="planner secret plan", agent_id="planner")
    engine.remember(text="researcher shared plan", agent_id="researcher", visibility="shared")
    engine.remember(text="unowned plan")
    see = lambda a: set(texts(engine.recall([{"query": "plan", "as_agent": a}])))
    assert see("researcher") == {"researcher shared plan", "unowned plan"}
    assert len(see("planner")) == 3 and len(see(None)) == 3


def test_lifecycle(engine):
    engine.config = Config(batch_min=3, batch_max=10, consolidate_after_s=0)
    engine.remember_batch([{"text": f"ops note {i} on the api", "session_id": "ops", "created_at": NOW - DAY + i, "importance": 0.1 * i} for i in range(5)])
    engine.remember(text="misc note", session_id="misc", created_at=NOW - DAY)
    engine.remember(text="a fact", kind="semantic", created_at=NOW - DAY)
    engine.remember(text="short lived", kind="working", created_at=NOW - 3 * DAY)
    report = engine.run_lifecycle()
    assert report == {"swept": 1, "batches": 1, "consolidated": 5, "checkpointed": False}
    rows = engine.live().collect()
    made = [r for r in rows if r["metadata"]]
    assert len(rows) == 3 and len(made) == 1 and len(made[0]["sources"]) == 5 and made[0]["importance"] == pytest.approx(0.4)
    assert json.loads(made[0]["metadata"])["consolidated"]["count"] == 5
    assert engine.run_lifecycle()["batches"] == 0


def test_snapshot_and_restore(spark, tmp_path, engine):
    engine.remember_batch([{"text": f"t{i}", "session_id": "alpha"} for i in range(3)] + [{"text": "b", "session_id": "beta"}])
    snap = engine.snapshot("alpha")
    assert snap.count() == 3
    write_snapshot(snap, f"{tmp_path}/snap")
    other = Engine(spark, f"file://{tmp_path}/other", clock=lambda: NOW)
    rows = read_snapshot(spark, f"{tmp_path}/snap")
    assert other.restore(rows) == 3 and other.restore(rows) == 0
    assert other.restore(rows.limit(1).withColumn("id", F.lit("new")).drop("embedding")) == 1
    total, page = other.list_memories(1, 2)
    assert total == 4 and page.count() == 2


def test_ingest(spark, tmp_path):
    said = {"facts": '[{"text": "Standup is on Thursday", "importance": 0.9}]', "picked": []}
    plugins = Plugins(extractor=lambda c, k: said["facts"], superseder=lambda f, old: [i for i, o in enumerate(old) if "Thursday" in o])
    e = Engine(spark, f"file://{tmp_path}/c", plugins=plugins, clock=lambda: NOW)
    turns = [{"role": "user", "content": "when is standup"}, {"role": "assistant", "content": "thursday"}]
    r = e.ingest(turns, session_id="s")
    assert (r.raw, r.facts, r.duplicates, r.extraction_ran) == (2, 1, 0, True)
    fact = e.get(r.ids[0])
    assert len(fact["sources"]) == 2 and fact["kind"] == "semantic"
    r = e.ingest(turns, store_raw=False)
    assert (r.raw, r.facts, r.duplicates) == (0, 0, 1)
    said["facts"] = '[{"text": "Standup moved to Monday"}, {"text": "Standup moved to Monday"}]'
    r = e.ingest(turns, store_raw=False, supersede=True)
    assert (r.facts, r.duplicates, r.superseded) == (1, 1, 1)
    assert e.get(fact["id"]) is None and fact["id"] in e.get(r.ids[0])["sources"]
    plain = Engine(spark, f"file://{tmp_path}/p", clock=lambda: NOW).ingest(turns)
    assert plain.raw == 2 and not plain.extraction_ran


def test_json_log(spark, tmp_path):
    path = tmp_path / "log.json"
    path.write_text('{"seq": 1, "op": "forget", "id": "a"}\n\nnot json\n{"seq": 2, "op": "set_sources", "id": "b", "sources": ["x"]}\n')
    assert sorted(r["id"] for r in read_json_log(spark, str(path)).collect()) == ["a", "b"]


def test_an_uncommitted_batch_is_not_seen(engine):
    engine.remember(text="one")
    m = engine.store.manifest()
    engine.store.tail().write.parquet(f"{engine.store._log(m['generation'])}/batch={m['next']:012d}")
    assert engine.store.tail().count() == 1


def test_streams(spark, tmp_path, engine):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text('{"text": "streamed one"}\n{"text": " "}\n')
    q = remember_stream(request_stream(spark, str(folder)), engine, f"{tmp_path}/ck")
    q.awaitTermination(60)
    (folder / "b.json").write_text('{"text": "streamed two"}\n')
    q = remember_stream(request_stream(spark, str(folder)), engine, f"{tmp_path}/ck")
    q.awaitTermination(60)
    assert sorted(r["text"] for r in engine.live().collect()) == ["streamed one", "streamed two"]
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:20:00", "a", 3.0), ("2024-01-01 03:00:00", "b", 5.0)], "t string, event_type string, value double").selectExpr("cast(t as timestamp) ts", "event_type", "value")
    events.write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events")
    w = request_rates(stream).writeStream.format("memory").queryName("rates").outputMode("append").trigger(availableNow=True).start()
    w.awaitTermination(60)
    assert [(r["event_type"], r["n"], r["mean"]) for r in spark.table("rates").collect()][:1] == [("a", 2, 2.0)]
    assert request_rates(events).count() == 2


def test_namespaces_and_keys(spark, tmp_path):
    reg = Registry(spark, f"file://{tmp_path}/r", lambda s, root, name: Engine(s, root, name, clock=lambda: NOW))
    reg.get_or_create("acme").remember(text="acme only")
    reg.get_or_create("globex")
    assert reg.get_or_create("globex").live().count() == 0 and reg.list() == ["acme", "globex"]
    assert reg.drop("acme") and not reg.drop("acme")
    for bad in ("", "a/b", "..", "x" * 65):
        with pytest.raises(BadRequest):
            validate(bad)
    admin, scoped = ApiKey.parse("admin-key-1"), ApiKey.parse("scoped-key:acme, globex")
    auth = Auth([admin, scoped])
    head = lambda k, ns: {"Authorization": f"Bearer {k}", "X-Namespace": ns}
    assert auth.resolve(head("scoped-key", "acme")) == "acme" and auth.resolve({"x-api-key": "admin-key-1"}, admin=True) == "default"
    for headers, error in (({}, Unauthorized), (head("wrong-key-0", "acme"), Unauthorized), (head("scoped-key", "other"), Forbidden)):
        with pytest.raises(error):
            auth.resolve(headers)
    with pytest.raises(Forbidden):
        auth.resolve(head("scoped-key", "acme"), admin=True)
    with pytest.raises(BadRequest):
        ApiKey.parse("short")


def test_http(spark, tmp_path):
    reg = Registry(spark, f"file://{tmp_path}/r", lambda s, root, name: Engine(s, root, name, clock=lambda: NOW))
    server = serve(reg, Auth([ApiKey.parse("admin-key-1"), ApiKey.parse("scoped-key:acme")]), port=0, style="off")
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def call(route, body=None, key=None, ns="acme"):
        headers = {"X-Namespace": ns} | ({"X-API-Key": key} if key else {})
        request = urllib.request.Request(f"http://127.0.0.1:{server.server_port}{route}", None if body is None else json.dumps(body).encode(), headers)
        try:
            with urllib.request.urlopen(request, timeout=60) as r:
                return r.status, r.read().decode()
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode()

    try:
        assert call("/healthz")[0] == 200
        assert call("/v1/remember", {"text": "hello"})[0] == 401
        assert call("/v1/remember", {"text": "hello"}, "scoped-key")[0] == 200
        assert call("/v1/remember", {"text": "hello"}, "scoped-key", "other")[0] == 403
        assert call("/v1/remember", {"text": " "}, "scoped-key")[0] == 400
        hits = json.loads(call("/v1/recall", {"query": "hello"}, "scoped-key")[1])["hits"]
        assert hits[0]["text"] == "hello"
        assert json.loads(call("/v1/memories?limit=5", None, "scoped-key")[1])["total"] == 1
        status, page = call("/metrics", None, "admin-key-1")
        assert status == 200 and 'engrama_memories{namespace="acme"} 1' in page and "engrama_requests_rejected_total 2" in page
    finally:
        server.shutdown()
        server.server_close()


def test_tools(engine):
    lines = io.StringIO("\n".join(json.dumps(x) for x in [{"id": 1, "method": "initialize"}, {"method": "note"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "memory_remember", "arguments": {"text": "by tool"}}}, {"id": 4, "method": "tools/call", "params": {"name": "memory_recall", "arguments": {"query": "tool"}}}, {"id": 5, "method": "odd"}]) + "\nbad\n")
    out = io.StringIO()
    stdio(engine, "me", lines, out)
    replies = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [r.get("id") for r in replies] == [1, 2, 3, 4, 5, None]
    assert "by tool" in replies[3]["result"]["content"][0]["text"] and replies[4]["error"]["code"] == -32601
    assert engine.live().first()["visibility"] == "private"


def test_metrics_and_log(caplog):
    m = Metrics()
    m.record("/v1/recall", 200, 0.0004)
    m.record("/v1/recall", 200, 0.03)
    page = m.render({'a"b': {"total_memories": 1, "vector_indexed": 1, "lexical_indexed": 1, "entities": 0, "wal_tail_ops": 2}})
    assert 'le="0.0005"} 1' in page and 'le="+Inf"} 2' in page and "_sum{route=\"/v1/recall\"} 0.0304" in page and 'namespace="a\\"b"' in page
    with caplog.at_level(logging.INFO, "engrama.requests"):
        log_request("json", "POST", "/x", "ns", 500, 1.0)
        log_request("off", "POST", "/x", "ns", 500, 1.0)
    assert len(caplog.records) == 1 and caplog.records[0].levelno == logging.ERROR and json.loads(caplog.records[0].message)["status"] == 500
    with pytest.raises(ValueError):
        log_request("xml", "", "", "", 200, 0)


def test_clients(spark):
    seen = []

    def post(url, body, headers):
        seen.append((url, body, headers))
        if url.endswith("/embeddings"):
            return {"data": [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in reversed(list(enumerate(body["input"])))]}
        if ":embedContent" in url:
            return {"embedding": {"values": [1.0, 2.0]}}
        return {"choices": [{"message": {"content": "```json\n[10, 25]\n```" if "Rate" in body["messages"][0]["content"] else "[1]"}}]}

    embed = embeddings_client("http://x/v1/", "m", "key", post)
    assert embed(["a", "bcd"]) == [[1.0, 1.0], [3.0, 1.0]] and dimension_of(embed) == 2
    assert content_client("http://y", "m", "k", post)(["a"]) == [[1.0, 2.0]]
    chat = chat_client("http://x/v1", "m", "", post)
    assert chat_reranker(chat)("q", ["a", "b"]) == [1.0, 1.0]
    assert chat_superseder(chat)("f", ["old"]) == [0] and chat_extractor(chat)("c", ["k"]) == "[1]"
    assert parse_scores("[0, 5]", 2) == [0.0, 0.5]
    with pytest.raises(ValueError):
        parse_scores("[1]", 2)
    column = embedding_column(lambda texts: [[float(len(t))] for t in texts], prefix="query: ")
    df = spark.createDataFrame([("ab",), (None,)], "t string")
    assert [r[0] for r in df.select(column(F.col("t"))).collect()] == [[9.0], None]


def test_summaries_of_supplied_vectors_are_found(spark, tmp_path):
    """Vectors longer than the embedder's: a summary gets the centroid of its sources, and the summariser is called once a batch."""
    calls = tmp_path / "calls"
    calls.mkdir()

    def summarizer(memories):
        (calls / uuid.uuid4().hex).write_text(str(len(memories)))
        return "in short: " + memories[0]

    now = 1_706_659_200_000
    engine = Engine(spark, f"file://{tmp_path}/c", plugins=Plugins(summarizer=summarizer), clock=lambda: now)
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(6, 384)) * 0.1 + rng.normal(size=384)
    old = now - 30 * 86_400_000
    engine.remember_batch([{"text": f"note {i}", "session_id": "s" if i < 5 else "other", "created_at": old + i, "embedding": v.tolist()} for i, v in enumerate(vectors)]).count()
    report = engine.run_lifecycle()
    assert report["batches"] == 1 and report["consolidated"] == 5 and len(list(calls.iterdir())) == 1
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    want = unit[:5].sum(axis=0) / np.linalg.norm(unit[:5].sum(axis=0))
    hit = engine.recall([{"query": "", "query_embedding": want.tolist(), "strategy": "semantic", "top_k": 1}]).first()
    assert hit["text"].startswith("in short") and hit["vector"] > 0
    found = engine.live().filter("kind = 'semantic'").first()
    assert np.allclose(found["embedding"], want) and len(found["sources"]) == 5


def test_snapshot_route_is_paged(spark, tmp_path):
    registry = Registry(spark, f"file://{tmp_path}/r", lambda s, root, name: Engine(s, root, name, clock=lambda: NOW))
    table = routes(registry)
    table["/v1/remember_batch"]("default", {"items": [{"text": f"note {i}", "created_at": 1_704_067_200_000 + i} for i in range(7)]})
    first = table["/v1/snapshot"]("default", {"limit": 5})
    rest = table["/v1/snapshot"]("default", {"limit": 5, "offset": first["next"]})
    assert [r["text"] for r in first["snapshot"] + rest["snapshot"]] == [f"note {i}" for i in range(7)] and rest["next"] is None
    table["/v1/snapshot"]("default", {"path": f"file://{tmp_path}/export"})
    assert spark.read.json(f"file://{tmp_path}/export").count() == 7
