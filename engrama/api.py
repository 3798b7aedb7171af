"""The engine: a memory collection on a ``Store``, and a dispatcher of its routes.

Reads are lazy DataFrames over immutable versions; writes append one batch each. One writer at a time per collection.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions.embedding import hash_embed
from .operators import aggregates, graph, ingest, lifecycle, oplog, records
from .operators import cells as vector_cells
from .operators.filters import matching
from .operators.ranking import top_k
from .plans.recall import recall, vector_leg
from .schema import BATCH_MAX, BATCH_MIN, CANDIDATES, CHECKPOINT_OPS, CONSOLIDATE_AFTER_S, DEDUP_COSINE, KNOWN_FACTS, MEMORY, SUPERSEDE_NEIGHBOURS, WORKING_TTL_S
from .sources.scratch import stored
from .sources.store import Store, write_snapshot
from .tenancy import BadRequest, Registry, validate


@dataclass
class Config:
    working_ttl_s: int | None = WORKING_TTL_S
    consolidate_after_s: int = CONSOLIDATE_AFTER_S
    batch_min: int = BATCH_MIN
    batch_max: int = BATCH_MAX
    #: ("session_id",) mixes agents of a session in one summary; with "agent_id" private rows stay apart.
    consolidate_by: tuple[str, ...] = ("session_id", "agent_id")


@dataclass
class Plugins:
    embed: Callable[[Column], Column] = hash_embed
    embed_query: Callable[[Column], Column] | None = None
    reranker: Callable | None = None
    summarizer: Callable[[list[str]], str] = lifecycle.summarize
    extractor: Callable[[str, list[str]], str] | None = None
    superseder: Callable[[str, list[str]], list[int]] | None = None


@dataclass
class IngestReport:
    raw: int = 0
    extraction_ran: bool = False
    facts: int = 0
    duplicates: int = 0
    superseded: int = 0
    ids: list[str] = field(default_factory=list)


class Engine:
    def __init__(self, spark: SparkSession, root: str, namespace: str = "default", config: Config | None = None, plugins: Plugins | None = None, clock: Callable[[], int] | None = None):
        self.spark, self.namespace = spark, namespace
        self.store = Store(spark, root)
        self.config, self.plugins = config or Config(), plugins or Plugins()
        self.now = clock or (lambda: int(time.time() * 1000))

    def live(self) -> DataFrame:
        return self.store.live()

    def _dim(self) -> int | None:
        """The collection's vector length: that of its first vector."""
        row = self.live().filter("embedding IS NOT NULL").select(F.size("embedding").alias("n")).limit(1).collect()
        return row[0]["n"] if row else None

    def _requests(self, requests: DataFrame | Sequence[dict]) -> DataFrame:
        if isinstance(requests, DataFrame):
            return requests
        names = records.REQUEST_COLUMNS
        unknown = {k for r in requests for k in r} - set(names)
        if unknown:
            raise BadRequest(f"unknown fields: {sorted(unknown)}")
        schema = ", ".join(f"`{n}` {k}" for n, k in names.items())
        rows = [tuple(float(r[n]) if n == "importance" and r.get(n) is not None else r.get(n) for n in names) for r in requests]
        return self.spark.createDataFrame(rows, schema)

    def remember_batch(self, requests: DataFrame | Sequence[dict], **marks) -> DataFrame:
        """All or nothing; returns the new records. ``marks`` go into the manifest with the batch's commit."""
        asked = records.complete(self._requests(requests))
        if asked.filter(F.col("embedding").isNotNull()).limit(1).count():
            checked = records.validated(asked, self._dim())
        else:
            checked = records.validated(asked)
        bad = checked.filter("problem IS NOT NULL").select("problem").limit(1).collect()
        if bad:
            raise BadRequest(bad[0]["problem"])
        first = self.store.manifest()["next"]
        # numbers within the batch, by content: a recomputed row keeps its own
        numbered = asked.withColumn("__copy", F.row_number().over(W.partitionBy("text", "kind", "created_at", "session_id", "agent_id").orderBy(*[c for c in records.REQUEST_COLUMNS if c not in ("text", "kind", "created_at", "session_id", "agent_id")])))
        numbered = numbered.withColumn("__seq", F.concat_ws(":", F.lit(str(first)), "__copy")).drop("__copy")
        built = records.build(numbered, self.now(), self.namespace, self.config.working_ttl_s, self.plugins.embed).drop("__seq")
        self.store.append(oplog.remember_ops(built, first), **marks)
        return self.store.tail().filter(F.col("seq") == first).select("record.*")

    def remember(self, **request) -> dict:
        return self.remember_batch([request]).first().asDict(recursive=True)

    def forget(self, *ids: str) -> bool:
        """Whether any of them was there."""
        gone = self.live().filter(F.col("id").isin(*ids)).select("id")
        if not gone.limit(1).count():
            return False
        self.store.append(oplog.forget_ops(gone, self.store.manifest()["next"]))
        return True

    def get(self, memory_id: str) -> dict | None:
        row = self.live().filter(F.col("id") == memory_id).first()
        return row.asDict(recursive=True) if row else None

    def set_sources(self, rows: DataFrame) -> None:
        """``rows``: id, sources."""
        self.store.append(oplog.source_ops(rows, self.store.manifest()["next"]))

    def recall(self, requests: DataFrame | Sequence[dict], rerank: bool = True) -> DataFrame:
        """Hits with their records' columns, without vectors."""
        if not isinstance(requests, DataFrame):
            from .plans.recall import OPTIONAL

            schema = "qid long, query string, " + ", ".join(f"`{n}` {k}" for n, k in OPTIONAL.items())
            requests = self.spark.createDataFrame([(r.get("qid", i), r.get("query", ""), *[r.get(n) for n in OPTIONAL]) for i, r in enumerate(requests)], schema)
        live = self.live()
        query = self.plugins.embed_query or self.plugins.embed
        hits = recall(requests, live, self.now(), self.plugins.reranker if rerank else None, query, self._indexed_leg())
        return hits.join(live.drop("embedding", "importance"), "id")

    def ingest(self, turns: Sequence[dict], session_id: str | None = None, agent_id: str | None = None, tags: Sequence[str] = (), created_at: int | None = None, visibility: str | None = None, store_raw: bool = True, extract: bool = True, supersede: bool = False, dedup_threshold: float = DEDUP_COSINE) -> IngestReport:
        """Store a conversation's turns and the facts an extractor finds in them."""
        report = IngestReport()
        base = {"session_id": session_id, "agent_id": agent_id, "tags": list(tags), "created_at": created_at, "visibility": visibility}
        facts: list[dict] = []
        gone: dict[str, list[str]] = {}
        if extract and turns and self.plugins.extractor is not None:
            facts, gone = self._plan(turns, agent_id, supersede, dedup_threshold, report)
        raw_ids: list[str] = []
        if store_raw and turns:
            raw = self.remember_batch([base | {"text": f"{t['role']}: {t['content']}", "kind": "episodic"} for t in turns])
            raw_ids = [r["id"] for r in raw.select("id").collect()]  # one exchange's turns
            report.raw = len(raw_ids)
        if facts:
            requests = [base | {"text": f["text"], "kind": f["kind"], "importance": f["importance"], "tags": [*tags, *f["tags"]], "embedding": f["embedding"], "sources": raw_ids + gone.get(f["text"], [])} for f in facts]
            stored = self.remember_batch(requests)
            report.ids = [r["id"] for r in stored.select("id").collect()]
            report.facts = len(report.ids)
        replaced = sorted({i for ids in gone.values() for i in ids})
        if replaced:
            self.forget(*replaced)
            report.superseded = len(replaced)
        return report

    def _plan(self, turns, agent_id, supersede, threshold, report) -> tuple[list[dict], dict[str, list[str]]]:
        conversation = "\n".join(f"{t['role']}: {t['content']}" for t in turns)
        known = self.recall([{"query": conversation, "kinds": ["semantic", "procedural"], "as_agent": agent_id, "top_k": KNOWN_FACTS}], rerank=False)
        texts = [r["text"] for r in known.orderBy("rank").select("text").collect()]
        found = ingest.parse_candidates(self.plugins.extractor(conversation, texts))
        report.extraction_ran = True
        if not found:
            return [], {}
        rows = self.spark.createDataFrame([(i, f["text"], f["kind"], float(f["importance"])) for i, f in enumerate(found)], "qid long, text string, kind string, importance double")
        rows = rows.withColumn("query_embedding", self.plugins.embed(F.col("text"))).withColumn("exchange", F.lit("x"))
        fresh = ingest.greedy_distinct(ingest.new_facts(rows, matching(self.live(), as_agent=agent_id), threshold), threshold, order="qid", vector="query_embedding")
        stay = {r["qid"]: list(r["query_embedding"]) for r in fresh.select("qid", "query_embedding").collect()}
        facts = [f | {"embedding": stay[i]} for i, f in enumerate(found) if i in stay]
        report.duplicates = len(found) - len(facts)
        gone: dict[str, list[str]] = {}
        if supersede and self.plugins.superseder is not None and facts:
            asked = [{"qid": i, "query": f["text"], "strategy": "semantic", "kinds": ["semantic", "procedural"], "as_agent": agent_id, "top_k": SUPERSEDE_NEIGHBOURS} for i, f in enumerate(facts)]
            near: dict[int, list] = {}
            for r in self.recall(asked, rerank=False).orderBy("qid", "rank").select("qid", "id", "text").collect():
                near.setdefault(r["qid"], []).append(r)
            for i, f in enumerate(facts):
                old = near.get(i, [])
                picked = self.plugins.superseder(f["text"], [r["text"] for r in old]) if old else []
                if picked:
                    gone[f["text"]] = [old[p]["id"] for p in picked]
        return facts, gone

    def run_lifecycle(self) -> dict:
        """Sweep what has expired, consolidate what is old, checkpoint a long log."""
        now, c = self.now(), self.config
        swept = lifecycle.expired(self.live(), now).select("id")
        n_swept = swept.count()
        if n_swept:
            self.store.append(oplog.forget_ops(swept, self.store.manifest()["next"]))
        live, by = self.live(), c.consolidate_by
        batched = lifecycle.batches(lifecycle.candidates(live, now, c.consolidate_after_s), c.batch_min, c.batch_max, by)
        texts = stored(lifecycle.summaries(batched, by, self.plugins.summarizer), "summaries")  # the summariser is called once a batch
        heads = lifecycle.consolidated(batched, now, by)
        same = [F.col(f"h.{b}").eqNullSafe(F.col(f"t.{b}")) for b in by] + [F.col("h.batch") == F.col("t.batch")]
        for s in same[1:]:
            same[0] = same[0] & s
        rows = heads.alias("h").join(texts.alias("t"), same[0]).select("h.*", "t.text")
        asked = rows.select(
            "text", "kind", "created_at", "importance", "sources", "agent_id", "tags", "visibility", "session_id",
            F.to_json(F.struct(F.struct("count", F.col("from_ms").alias("from"), F.col("to_ms").alias("to")).alias("consolidated"))).alias("metadata"),
        )
        built = stored(self._with_centroids(records.build(asked, now, self.namespace, None, self.plugins.embed), live), "consolidated")
        first = self.store.manifest()["next"]
        ops = oplog.remember_ops(built, first).unionByName(oplog.forget_ops(built.select(F.explode("sources").alias("id")).distinct(), first))
        self.store.append(ops)
        added = self.store.tail().filter(F.col("seq") == first)
        done = added.agg(F.count(F.when(F.col("op") == "remember", 1)).alias("summaries"), F.count(F.when(F.col("op") == "forget", 1)).alias("consolidated")).first()
        report = {"swept": n_swept, "batches": done["summaries"], "consolidated": done["consolidated"], "checkpointed": False}
        if self.store.tail().count() >= CHECKPOINT_OPS:
            self.checkpoint()
            report["checkpointed"] = True
        return report

    def _with_centroids(self, built: DataFrame, live: DataFrame) -> DataFrame:
        """Summaries whose vectors are not as long as the collection's get the centroid of their sources' vectors, which makes them found again."""
        dim = self._dim()
        if dim is None or not built.filter(F.size("embedding") != dim).limit(1).count():
            return built
        sources = built.select(F.col("id").alias("of"), F.explode("sources").alias("id")).join(live.filter(F.size("embedding") == dim).select("id", "embedding"), "id")
        found = records.centroid(sources, "of").select(F.col("of").alias("id"), F.col("embedding").alias("__centroid"))
        fits = F.size("embedding") == dim
        return built.join(found, "id", "left").withColumn("embedding", F.when(fits, F.col("embedding")).otherwise(F.col("__centroid"))).select(*built.columns)

    def build_index(self, cells: int = 64, mode: str = "auto") -> None:
        """Write an index of the live vectors, which ``recall`` uses from then on; the one before stays until ``compact``."""
        m = self.store.manifest()
        name = f"index/v{m['version'] + 1:012d}"
        self.store.files.delete(name)  # what a failed attempt left
        vector_cells.write_index(self.live(), f"{self.store.root}/{name}", cells, mode, filtered=True)
        self.store.commit(index=name, indexed=m["next"])

    def refresh_index(self) -> None:
        """Bring what changed since the index was written into it. A broken attempt may be repeated: what it appended is removed first."""
        m = self.store.manifest()
        if not m.get("index"):
            return
        touched = self.store.tail().filter(F.col("seq") >= m["indexed"]).select("id").distinct()
        if not touched.isEmpty():
            path = f"{self.store.root}/{m['index']}"
            vector_cells.remove(touched, path)
            vector_cells.append(self.live().join(touched, "id", "left_semi"), path)
        self.store.commit(indexed=m["next"])

    def _indexed_leg(self) -> Callable | None:
        """The leg of vectors by the index, and by exact search over rows changed since; None without an index, or if changes left the log unseen."""
        m = self.store.manifest()
        if not m.get("index") or m["indexed"] < m["tail"]:
            return None

        def leg(requests: DataFrame, memories: DataFrame, now: int, k: int = CANDIDATES) -> DataFrame:
            touched = self.store.tail().filter(F.col("seq") >= m["indexed"]).select("id").distinct()
            found = vector_cells.search(requests, f"{self.store.root}/{m['index']}", k, filtered=True, now=now, without=touched)
            late = vector_leg(requests, memories.join(touched, "id", "left_semi"), now, k)
            return top_k(found.unionByName(late).drop("rank"), "score", k)

        return leg

    def checkpoint(self) -> bool:
        self.refresh_index()
        self.store.checkpoint()
        return True

    def compact(self) -> None:
        """Rewrite the live rows and drop what is no longer needed."""
        self.checkpoint()
        self.store.vacuum()

    def snapshot(self, session_id: str | None = None) -> DataFrame:
        return records.snapshot(self.live(), self.now(), session_id)

    def restore(self, rows: DataFrame) -> int:
        """How many rows were not there yet."""
        have = {f.name for f in MEMORY}
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in MEMORY if f.name in have])
        fresh = records.to_restore(rows, self.live()).withColumn("embedding", F.coalesce("embedding", self.plugins.embed(F.col("text"))))
        first = self.store.append(oplog.remember_ops(fresh, self.store.manifest()["next"]))
        return self.store.tail().filter(F.col("seq") == first).count()

    def list_memories(self, offset: int = 0, limit: int = 50) -> tuple[int, DataFrame]:
        live = self.live()
        return live.count(), records.page(live, offset, limit)

    def top_entities(self, limit: int = 40) -> DataFrame:
        return graph.top_entities(self.live(), limit)

    def stats(self) -> dict:
        return aggregates.stats(self.live(), self.store.tail().count()).first().asDict()


#: Rows that one answer of the HTTP routes lists.
MOST_ROWS = 200
#: Records in one answer of the snapshot route.
MOST_SNAPSHOT = 10_000


def routes(registry: Registry) -> dict[str, Callable[[str, dict], dict]]:
    """Route -> function of (namespace, body): what an HTTP server would call after authentication."""
    of = registry.get_or_create
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]  # noqa: E731  answers of bounded size

    def snapshot(ns: str, body: dict) -> dict:
        """A page of a snapshot, or with ``path`` all of it as JSON lines in that folder. ``next``: the offset of the page that follows."""
        found = of(ns).snapshot(body.get("session_id"))
        if body.get("path"):
            write_snapshot(found, body["path"])
            return {"path": body["path"]}
        offset, limit = int(body.get("offset", 0)), min(int(body.get("limit", MOST_SNAPSHOT)), MOST_SNAPSHOT)
        page = rows(found.offset(offset).limit(limit + 1))
        return {"snapshot": page[:limit], "next": offset + limit if len(page) > limit else None}

    def memories(ns: str, body: dict) -> dict:
        total, page = of(ns).list_memories(int(body.get("offset", 0)), min(int(body.get("limit", 50)), MOST_ROWS))
        return {"total": total, "records": rows(page.drop("embedding"))}

    def restore(ns: str, body: dict) -> dict:
        return {"restored": of(ns).restore(registry.spark.createDataFrame([tuple(r.get(f.name) for f in MEMORY) for r in body["records"]], MEMORY))}

    return {
        "/v1/remember": lambda ns, b: {"record": {k: v for k, v in of(ns).remember(**b).items() if k != "embedding"}},
        "/v1/remember_batch": lambda ns, b: {"records": rows(of(ns).remember_batch(b["items"]).drop("embedding"))},
        "/v1/ingest": lambda ns, b: {"report": vars(of(ns).ingest(**b))},
        "/v1/recall": lambda ns, b: {"hits": rows(of(ns).recall([b]).orderBy("rank"))},
        "/v1/forget": lambda ns, b: {"forgotten": of(ns).forget(b["id"])},
        "/v1/checkpoint": lambda ns, b: {"checkpointed": of(ns).checkpoint()},
        "/v1/lifecycle/run": lambda ns, b: {"report": of(ns).run_lifecycle()},
        "/v1/snapshot": snapshot,
        "/v1/restore": restore,
        "/v1/memories": memories,
        "/v1/entities": lambda ns, b: {"entities": [{"name": r["entity"], "count": r["cnt"]} for r in of(ns).top_entities(min(int(b.get("limit", 40)), MOST_ROWS)).collect()]},
        "/v1/namespaces": lambda ns, b: {"namespaces": registry.list()},
        "/v1/namespaces/drop": lambda ns, b: {"dropped": registry.drop(validate(b["namespace"]))},
        "/health": lambda ns, b: {"status": "ok", "namespace": ns, "stats": of(ns).stats()},
        "/healthz": lambda ns, b: {"status": "ok"},
    }


#: Routes that need a key without a scope.
ADMIN = frozenset({"/v1/namespaces", "/v1/namespaces/drop", "/metrics"})


def tool(engine: Engine, name: str, arguments: dict, agent_id: str | None = None) -> dict:
    """The three tools of an agent: memory_remember, memory_recall, memory_forget."""
    if name == "memory_remember":
        return {"id": engine.remember(**({"agent_id": agent_id} | arguments if agent_id else arguments))["id"]}
    if name == "memory_recall":
        hits = engine.recall([{"as_agent": agent_id} | arguments]).orderBy("rank").select("id", "text", "score").collect()
        return {"hits": [h.asDict() for h in hits]}
    if name == "memory_forget":
        return {"forgotten": engine.forget(arguments["id"])}
    raise BadRequest(f"unknown tool {name}")
