"""Every operator as a query over the test tables, with the same in DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vx
from ..functions.embedding import hash_embed
from ..functions.entities import STOPWORDS, extract_entities
from ..functions.time import STAMP
from ..functions.time import stamp_to_ms as to_ms
from ..operators import aggregates, cells, filters, graph, ingest, knn, lexical, lifecycle, oplog, records
from ..operators.ranking import fuse, recency, top_k
from ..plugins import keyword_reranker
from ..schema import MEMORIES_SQL, NOW_MS, STRATEGIES, fixture_memories
from . import recall as plan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query; ``sql`` is what DuckDB runs for it."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


mem = fixture_memories
MEM = MEMORIES_SQL
M = f"WITH {MEM} "
PLAIN = "id, kind, created_at, importance, expires_at, session_id, agent_id, visibility"


def plain(df: DataFrame) -> DataFrame:
    return df.select(*PLAIN.split(", "))


def bench(spark: SparkSession, d: str) -> DataFrame:
    """A request per benchmark passage, the whole of it."""
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


REQ = "req AS (SELECT item_id AS qid, text AS query FROM benchmark)"
TOK = r"[x FOR x IN regexp_split_to_array(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}]+') IF x <> '']"

# ---------------------------------------------------------------- filters

FILTERS = {
    "filter_kinds": ({"kinds": ["episodic", "procedural"]}, "kind IN ('episodic', 'procedural')"),
    "filter_session": ({"session_id": "s7"}, "session_id = 's7'"),
    "filter_agent": ({"agent_id": "planner"}, "agent_id = 'planner'"),
    "filter_tags_all": ({"tags": ["t2", "u1"]}, "list_contains(tags, 't2') AND list_contains(tags, 'u1')"),
    "filter_time_range": ({"since": 1_704_100_000_000, "until": 1_704_300_000_000}, "created_at BETWEEN 1704100000000 AND 1704300000000"),
    "filter_unexpired": ({"now": NOW_MS}, f"(expires_at IS NULL OR expires_at > {NOW_MS})"),
    "visibility_as_agent": ({"as_agent": "planner"}, "(visibility = 'shared' OR agent_id IS NULL OR agent_id = 'planner')"),
    "get_by_id": ({}, "id = 'm5-1'"),
}
for _name, (_constraints, _where) in FILTERS.items():
    if _name == "get_by_id":
        query(M + f"SELECT {PLAIN} FROM mem WHERE {_where}", _name)(lambda s, d: plain(mem(s, d).filter(F.col("id") == "m5-1")))
    else:
        query(M + f"SELECT {PLAIN} FROM mem WHERE {_where}", _name)(lambda s, d, c=_constraints: plain(filters.matching(mem(s, d), **c)))


@query(M + f"SELECT {PLAIN} FROM mem WHERE session_id = 's3' AND (expires_at IS NULL OR expires_at > {NOW_MS}) ORDER BY created_at, id")
def snapshot_session(s, d):
    return plain(records.snapshot(mem(s, d), NOW_MS, "s3"))


@query(M + f"SELECT {PLAIN} FROM mem ORDER BY created_at DESC, id LIMIT 50 OFFSET 25")
def list_memories_page(s, d):
    return plain(records.page(mem(s, d), 25, 50))


@query(M + "SELECT id, text FROM mem WHERE NOT (kind = 'semantic')")
def restore_idempotent(s, d):
    m = mem(s, d)
    return records.to_restore(m, m.filter("kind = 'semantic'")).select("id", "text")


@query(M + "SELECT id FROM mem WHERE NOT (session_id IN ('s1', 's2'))")
def forget_antijoin(s, d):
    m = mem(s, d)
    return oplog.without(m, m.filter(F.col("session_id").isin("s1", "s2"))).select("id")


def _raw_requests(s, d):
    c = table(s, d, "conversations")
    stamp = F.when(F.col("turn") == 3, F.lit(-1)).when(F.col("turn") == 5, F.lit(1_704_067_200) + F.col("conv_id")).when(F.col("turn") == 6, F.lit(None)).otherwise(F.lit(1_704_067_200_000) + F.col("conv_id"))
    return c.select(
        F.concat(F.lit("r"), "conv_id", F.lit("-"), "turn").alias("rid"), F.when(F.col("turn") == 4, "  ").otherwise(F.col("text")).alias("text"),
        F.when(F.col("role") == "system", "working").when(F.col("role") == "user", F.lit(None)).otherwise("semantic").alias("kind"), stamp.cast("long").alias("created_at"),
        F.when(F.col("turn") % 2 == 0, F.lit(1.7)).alias("importance"), F.when(F.col("conv_id") % 4 == 0, F.lit(60).cast("long")).alias("ttl_seconds"),
        F.when(F.col("conv_id") % 2 == 0, "planner").alias("agent_id"), F.when(F.col("conv_id") % 6 == 0, "shared").alias("visibility"),
    )


RAW = """raw AS (SELECT 'r' || conv_id || '-' || turn AS rid, CASE WHEN turn = 4 THEN '  ' ELSE text END AS text,
 CASE role WHEN 'system' THEN 'working' WHEN 'user' THEN NULL ELSE 'semantic' END AS kind,
 CASE turn WHEN 3 THEN -1 WHEN 5 THEN 1704067200 + conv_id WHEN 6 THEN NULL ELSE 1704067200000 + conv_id END AS created_at,
 CASE WHEN turn % 2 = 0 THEN 1.7::DOUBLE END AS importance, CASE WHEN conv_id % 4 = 0 THEN 60 END AS ttl_seconds,
 CASE WHEN conv_id % 2 = 0 THEN 'planner' END AS agent_id, CASE WHEN conv_id % 6 = 0 THEN 'shared' END AS visibility FROM conversations)"""


@query(f"WITH {RAW} SELECT rid, CASE WHEN trim(coalesce(text, '')) = '' THEN 'text is empty' WHEN created_at <= 0 THEN 'created_at must be positive' WHEN created_at < 100000000000 THEN 'created_at looks like seconds; use milliseconds: ' || (created_at * 1000) END AS problem FROM raw")
def validate_requests(s, d):
    return records.validated(_raw_requests(s, d)).select("rid", "problem")


BUILT = f"""built AS (SELECT rid, coalesce(kind, 'episodic') AS kind, text, coalesce(created_at, {NOW_MS}) AS created_at, least(greatest(coalesce(importance, 0.5), 0), 1)::DOUBLE AS importance,
 coalesce(created_at, {NOW_MS}) + coalesce(ttl_seconds, CASE WHEN kind = 'working' THEN 86400 END) * 1000 AS expires_at, agent_id,
 coalesce(visibility, CASE WHEN agent_id IS NOT NULL THEN 'private' ELSE 'shared' END) AS visibility FROM raw)"""


@query(f"WITH {RAW}, {BUILT} SELECT rid, kind, created_at, importance, expires_at, agent_id, visibility FROM built")
def build_record(s, d):
    r = _raw_requests(s, d).withColumn("__seq", F.col("rid"))
    built = records.build(r, NOW_MS)
    return built.select(F.col("__seq").alias("rid"), "kind", "created_at", "importance", "expires_at", "agent_id", "visibility")


@query(f"WITH {RAW}, {BUILT} SELECT rid, kind, text, importance, expires_at FROM built WHERE trim(coalesce(text, '')) <> '' AND created_at > 0 AND created_at >= 100000000000")
def remember_batch(s, d):
    good = records.validated(_raw_requests(s, d)).filter("problem IS NULL").withColumn("__seq", F.col("rid"))
    return records.build(good, NOW_MS).select(F.col("__seq").alias("rid"), "kind", "text", "importance", "expires_at")


# ---------------------------------------------------------------- log


def _ops(s, d):
    """A log: all turns remembered twice, every third forgotten, some of these remembered again, sources set on some."""
    c = table(s, d, "conversations").select(F.concat(F.lit("m"), "conv_id", F.lit("-"), "turn").alias("id"), "conv_id", "turn", "text")
    op = lambda seq, kind, rows, text, sources: rows.select(seq.cast("long").alias("seq"), F.lit(kind).alias("op"), "id", text.alias("text"), sources.cast("array<string>").alias("sources"))
    none, empty = F.lit(None).cast("string"), F.array()
    first = op(F.lit(1), "remember", c, F.col("text"), empty)
    again = op(F.lit(2), "remember", c, F.lit("changed"), empty)
    gone = op(F.lit(3), "forget", c.filter((F.col("conv_id") + F.col("turn")) % 3 == 0), none, F.lit(None))
    back = op(F.lit(4), "remember", c.filter((F.col("conv_id") + F.col("turn")) % 6 == 0), F.concat(F.lit("back "), "text"), F.array(F.lit("a")))
    linked = op(F.lit(5) + F.col("turn"), "set_sources", c.filter(F.col("turn") % 2 == 0), none, F.array(F.lit("x"), F.concat(F.lit("y"), "turn")))
    return first.unionByName(again).unionByName(gone).unionByName(back).unionByName(linked)


def _as_oplog(rows: DataFrame) -> DataFrame:
    from ..schema import MEMORY

    fields = {"id": F.col("id"), "text": F.col("text"), "sources": F.col("sources")}
    record = F.struct(*[fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in MEMORY])
    return rows.select("seq", "op", "id", F.when(F.col("op") == "remember", record).alias("record"), F.when(F.col("op") == "set_sources", F.col("sources")).alias("sources"))


@query("""WITH c AS (SELECT 'm' || conv_id || '-' || turn AS id, conv_id, turn, text FROM conversations),
live AS (SELECT id, turn, CASE WHEN (conv_id + turn) % 6 = 0 THEN 'back ' || text ELSE text END AS text, CASE WHEN (conv_id + turn) % 6 = 0 THEN ['a'] ELSE [] END AS own
 FROM c WHERE (conv_id + turn) % 3 <> 0 OR (conv_id + turn) % 6 = 0)
SELECT id, text, array_to_string(CASE WHEN turn % 2 = 0 THEN ['x', 'y' || turn] ELSE own END, ',') AS sources FROM live""")
def oplog_fold(s, d):
    return oplog.fold(_as_oplog(_ops(s, d))).select("id", "text", F.array_join("sources", ",").alias("sources"))


LOG = """WITH c AS (SELECT 'm' || conv_id || '-' || turn AS id, conv_id, turn FROM conversations)
SELECT 1::BIGINT AS seq, 'remember' AS op, id FROM c UNION ALL SELECT 2, 'remember', id FROM c UNION ALL SELECT 3, 'forget', id FROM c WHERE (conv_id + turn) % 3 = 0
UNION ALL SELECT 4, 'remember', id FROM c WHERE (conv_id + turn) % 6 = 0 UNION ALL SELECT 5 + turn, 'set_sources', id FROM c WHERE turn % 2 = 0"""


@query(LOG)
def oplog_scan(s, d):
    """Written as JSON lines in the shared folder and read back."""
    from ..sources.store import read_json_log, write_json_log
    from ..sources.scratch import scratch

    path = scratch(s, "log")
    write_json_log(_as_oplog(_ops(s, d)), path)
    return read_json_log(s, path).select("seq", "op", "id")


@query(ORACLES["oplog_fold"])
def compact(s, d):
    """A collection is filled, partly forgotten and compacted; its records are read back."""
    from ..sources.store import Store
    from ..sources.scratch import scratch

    store = Store(s, scratch(s, "store"))
    store.append(_as_oplog(_ops(s, d)), 20)
    store.checkpoint()
    store.vacuum()
    return store.live().select("id", "text", F.array_join("sources", ",").alias("sources"))


# ---------------------------------------------------------------- vectors


@query("SELECT vec_id, round(list_sum([x::DOUBLE * x::DOUBLE FOR x IN embedding]), 6) AS before, round(list_sum([(3 * x::DOUBLE / sqrt(list_sum([9 * y::DOUBLE * y::DOUBLE FOR y IN embedding]))) ** 2 FOR x IN embedding]), 6) AS after, round(3 * embedding[1]::DOUBLE / sqrt(list_sum([9 * y::DOUBLE * y::DOUBLE FOR y IN embedding])), 6) AS first FROM embeddings")
def vec_normalize(s, d):
    e = table(s, d, "embeddings").withColumn("v", vx.normalize(F.transform("embedding", lambda x: x.cast("double") * 3)))
    return e.select("vec_id", F.round(vx.dot(F.col("embedding"), F.col("embedding")), 6).alias("before"), F.round(vx.dot(F.col("v"), F.col("v")), 6).alias("after"), F.round(F.get("v", F.lit(0)), 6).alias("first"))


#: A query set: every vector whose id is divisible by 50.
PROBES = "q AS (SELECT vec_id AS qid, embedding AS qe FROM embeddings WHERE vec_id % 50 = 0)"
DOT = "list_inner_product(qe::DOUBLE[], embedding::DOUBLE[])"


def probes(s, d):
    return table(s, d, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), vx.as_doubles(F.col("embedding")).alias("query_embedding"))


def _next_vectors(s, d):
    """Each vector beside that of the next id."""
    e = table(s, d, "embeddings")
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")


NEXT = "n AS (SELECT a.vec_id, a.embedding AS embedding, b.embedding AS qe FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"


@query(f"WITH {NEXT} SELECT vec_id, round({DOT}, 6) AS dot FROM n")
def vec_dot(s, d):
    return _next_vectors(s, d).select("vec_id", F.round(vx.dot(F.col("embedding"), F.col("other")), 6).alias("dot"))


@query(f"WITH {NEXT} SELECT vec_id, round(1 - {DOT}, 6) AS distance FROM n")
def vec_distance(s, d):
    return _next_vectors(s, d).select("vec_id", F.round(vx.distance(F.col("embedding"), F.col("other")), 6).alias("distance"))


def _knn_sql(where: str = "true", k: int = 10) -> str:
    return f"WITH {PROBES}, x AS (SELECT qid, vec_id, {DOT} AS s FROM q, embeddings WHERE {where}), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, vec_id) AS rank FROM x) SELECT qid, rank, vec_id, round(s, 6) AS score FROM r WHERE rank <= {k}"


def _hits(df: DataFrame, key: str = "vec_id") -> DataFrame:
    return df.select("qid", "rank", key, F.round("score", 6).alias("score"))


@query(_knn_sql())
def knn_exact(s, d):
    return _hits(knn.knn(probes(s, d), table(s, d, "embeddings"), 10, key="vec_id"))


@query(_knn_sql("label IN (1, 4)", 5))
def knn_filtered(s, d):
    return _hits(knn.knn(probes(s, d), table(s, d, "embeddings").filter(F.col("label").isin(1, 4)), 5, key="vec_id"))


@query(_knn_sql("true", 3).replace("list_inner_product(qe::DOUBLE[], embedding::DOUBLE[])", "list_inner_product([2 * x FOR x IN qe::DOUBLE[]], embedding::DOUBLE[]) / sqrt(list_inner_product([2 * x FOR x IN qe::DOUBLE[]], [2 * x FOR x IN qe::DOUBLE[]]))"))
def byo_knn(s, d):
    """Vectors the caller supplies, normalised on arrival."""
    supplied = probes(s, d).withColumn("query_embedding", vx.normalize(F.transform("query_embedding", lambda x: x * 2)))
    return _hits(knn.knn(supplied, table(s, d, "embeddings"), 3, key="vec_id"))


@query(f"WITH {PROBES}, x AS (SELECT qid, vec_id, {DOT} AS s FROM q, embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, vec_id) AS rank FROM x) SELECT qid, vec_id, round(s, 6) AS score FROM r WHERE rank = 1")
def nearest_similarity(s, d):
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return records.nearest(probes(s, d), e).select("qid", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


def _by_cells(s, d, mode: str) -> DataFrame:
    from ..sources.scratch import scratch

    path = scratch(s, "cells")
    cells.write_index(table(s, d, "embeddings"), path, 16, mode, key="vec_id")
    return _hits(cells.search(probes(s, d), path, 10, n_probe=8, key="vec_id", bounded=True))


@query()
def knn_ann(s, d):
    return _by_cells(s, d, "never")


@query()
def knn_ann_sq8(s, d):
    return _by_cells(s, d, "always")


SQ8 = """sq AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, list_min(embedding::DOUBLE[]) AS lo, greatest((list_max(embedding::DOUBLE[]) - list_min(embedding::DOUBLE[])) / 255.0, 1.1754943508222875e-38) AS delta FROM embeddings),
sq8 AS (SELECT vec_id, label, v, lo, delta, [least(greatest(round((x - lo) / delta), 0), 255)::BIGINT FOR x IN v] AS codes FROM sq)"""


def _sq8(s, d):
    return table(s, d, "embeddings").withColumn("q", vx.sq8_encode(F.col("embedding")))


@query(f"WITH {SQ8} SELECT vec_id, round(lo, 6) AS low, round(delta, 9) AS delta, array_to_string(codes, ',') AS codes FROM sq8")
def sq8_encode(s, d):
    return _sq8(s, d).select("vec_id", F.round("q.min", 6).alias("low"), F.round("q.delta", 9).alias("delta"), F.array_join(F.col("q.codes").cast("array<string>"), ",").alias("codes"))


@query(f"WITH {SQ8} SELECT vec_id, round(list_max([abs(z[1] - (lo + delta * z[2])) FOR z IN list_zip(v, codes)]), 6) AS worst, list_max([abs(z[1] - (lo + delta * z[2])) FOR z IN list_zip(v, codes)]) <= delta AS within FROM sq8")
def sq8_decode(s, d):
    worst = F.array_max(F.zip_with(vx.as_doubles(F.col("embedding")), vx.sq8_decode(F.col("q")), lambda a, b: F.abs(a - b)))
    return _sq8(s, d).select("vec_id", F.round(worst, 6).alias("worst"), (worst <= F.col("q.delta")).alias("within"))


@query(f"WITH {SQ8}, {PROBES}, x AS (SELECT qid, vec_id, list_inner_product(qe::DOUBLE[], [lo + delta * c FOR c IN codes]) AS s FROM q, sq8), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, vec_id) AS rank FROM x) SELECT qid, rank, vec_id, round(s, 6) AS score FROM r WHERE rank <= 10")
def sq8_knn(s, d):
    stored = _sq8(s, d).select("vec_id", vx.sq8_decode(F.col("q")).alias("embedding"))
    return _hits(knn.knn(probes(s, d), stored, 10, key="vec_id"))


@query(f"WITH {SQ8} SELECT a.vec_id, round(list_inner_product(b.v, [a.lo + a.delta * c FOR c IN a.codes]), 6) AS dot FROM sq8 a JOIN sq8 b ON b.vec_id = a.vec_id + 1")
def sq8_dot(s, d):
    """Plain vectors against codes, which are never decoded."""
    n = _next_vectors(s, d).withColumn("q", vx.sq8_encode(F.col("embedding")))
    return n.select("vec_id", F.round(vx.sq8_dot(F.col("other"), F.col("q")), 6).alias("dot"))


@query()
def knn_index_recall(s, d):
    """Of the index in both modes, against exact search."""
    truth, out = knn_exact(s, d), None
    for mode in ("never", "always"):
        one = aggregates.recall_at_k(_by_cells(s, d, mode), truth, key="vec_id").withColumn("mode", F.lit(mode))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {SQ8} SELECT a.vec_id, round(list_inner_product([a.lo + a.delta * c FOR c IN a.codes], [b.lo + b.delta * c FOR c IN b.codes]), 6) AS dot FROM sq8 a JOIN sq8 b ON b.vec_id = a.vec_id + 1")
def sq8_dot_between(s, d):
    q = _sq8(s, d).select("vec_id", "q")
    pairs = q.join(q.select((F.col("vec_id") - 1).alias("vec_id"), F.col("q").alias("p")), "vec_id")
    return pairs.select("vec_id", F.round(vx.sq8_dot_between(F.col("q"), F.col("p")), 6).alias("dot"))


@query("WITH p AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), t AS (SELECT label, i, sum(x) AS x FROM p GROUP BY ALL), n AS (SELECT label, sqrt(sum(x * x)) AS n FROM t GROUP BY label) SELECT label, i::INT AS pos, round(x / n, 6) AS x FROM t JOIN n USING (label)")
def centroid_by_label(s, d):
    c = records.centroid(table(s, d, "embeddings"), "label")
    return c.select("label", F.posexplode("embedding").alias("pos", "x")).select("label", (F.col("pos") + 1).alias("pos"), F.round("x", 6).alias("x"))


@query(f"WITH {SQ8}, {PROBES}, x AS (SELECT qid, vec_id, {DOT.replace('embedding::', 'v::')} AS s, list_inner_product(qe::DOUBLE[], [lo + delta * c FOR c IN codes]) AS t FROM q, sq8), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, vec_id) AS a, row_number() OVER (PARTITION BY qid ORDER BY round(t, 9) DESC, vec_id) AS b FROM x) SELECT count(*) FILTER (a <= 10 AND b <= 10) AS hits, count(*) FILTER (a <= 10) AS total, round(count(*) FILTER (a <= 10 AND b <= 10) / count(*) FILTER (a <= 10), 6) AS recall FROM r")
def recall_at_k(s, d):
    """Of 8-bit vectors against exact ones."""
    r = aggregates.recall_at_k(sq8_knn(s, d), knn_exact(s, d), key="vec_id")
    return r.select("hits", "total", F.round("recall", 6).alias("recall"))


# ---------------------------------------------------------------- lexical


@query(f"SELECT doc_id, array_to_string({TOK.format('text')}, ' ') AS tokens FROM documents")
def tokenize(s, d):
    return table(s, d, "documents").select("doc_id", F.array_join(tx.tokenize(F.col("text")), " ").alias("tokens"))


POST = f"toks AS (SELECT doc_id, {TOK.format('text')} AS t FROM documents), post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM toks) GROUP BY ALL)"


@query(f"WITH {POST} SELECT doc_id, term, tf FROM post")
def postings(s, d):
    return lexical.postings(table(s, d, "documents"), "doc_id")


@query(f"WITH {POST} SELECT doc_id, len(t)::BIGINT AS dl FROM toks")
def doc_len(s, d):
    return lexical.doc_lengths(table(s, d, "documents"), "doc_id")


@query(f"WITH {POST} SELECT term, count(*) AS df FROM post GROUP BY term")
def doc_freq(s, d):
    return lexical.doc_frequencies(table(s, d, "documents"), "doc_id")


@query(f"WITH {POST} SELECT count(*) AS n, round(avg(len(t)), 6) AS avgdl FROM toks")
def corpus_stats(s, d):
    return lexical.corpus_stats(table(s, d, "documents")).select("n", F.round("avgdl", 6).alias("avgdl"))


def bm25_ctes(corpus: str = "documents", key: str = "doc_id", where: str = "true", scored: str = "true", tag: str = "") -> str:
    """CTE ``bm25<tag>`` (qid, key, s): statistics over ``where``, scores for ``scored``."""
    return f"""c{tag} AS (SELECT * FROM {corpus} WHERE {where}), t{tag} AS MATERIALIZED (SELECT {key}, {TOK.format('text')} AS t FROM c{tag}),
p{tag} AS (SELECT {key}, term, dl, tf FROM (SELECT {key}, term, count(*) AS tf FROM (SELECT {key}, unnest(t) AS term FROM t{tag}) GROUP BY {key}, term) JOIN (SELECT {key}, len(t) AS dl FROM t{tag}) USING ({key})),
df{tag} AS (SELECT term, count(*) AS df FROM p{tag} GROUP BY term), st{tag} AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM t{tag}),
qt{tag} AS (SELECT qid, term, count(*) AS times FROM (SELECT qid, unnest({TOK.format('query')}) AS term FROM req) GROUP BY ALL),
bm25{tag} AS (SELECT qid, {key}, sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS s
 FROM p{tag} JOIN df{tag} USING (term) JOIN qt{tag} USING (term), st{tag} WHERE {key} IN (SELECT {key} FROM c{tag} WHERE {scored}) GROUP BY qid, {key})"""


def ranked_sql(cte: str, key: str, k: int, name: str = "score") -> str:
    return f"SELECT qid, rank, {key}, round(s, 6) AS {name} FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, {key}) AS rank FROM {cte}) WHERE rank <= {k}"


@query(f"WITH {REQ}, {bm25_ctes()} {ranked_sql('bm25', 'doc_id', 10)}")
def bm25_topk(s, d):
    return _hits(lexical.bm25_topk(bench(s, d), table(s, d, "documents"), 10, "doc_id"), "doc_id")


@query(f"WITH {REQ}, {bm25_ctes(scored=chr(39).join(['lang = ', 'fr', '']))} {ranked_sql('bm25', 'doc_id', 10)}")
def bm25_filtered(s, d):
    return _hits(lexical.bm25_topk(bench(s, d), table(s, d, "documents"), 10, "doc_id", where=F.col("lang") == "fr"), "doc_id")


@query(f"WITH {REQ}, {bm25_ctes(where='source <> ' + repr('src3'))} {ranked_sql('bm25', 'doc_id', 10)}")
def bm25_after_forget(s, d):
    return _hits(lexical.bm25_topk(bench(s, d), table(s, d, "documents").filter("source <> 'src3'"), 10, "doc_id"), "doc_id")


@query(ORACLES["bm25_topk"])
def bm25_indexed(s, d):
    """From an index written first."""
    from ..sources.scratch import scratch

    path = scratch(s, "postings")
    lexical.write_index(table(s, d, "documents"), path, 16, "doc_id")
    return _hits(top_k(lexical.bm25_indexed(bench(s, d), path, 16, "doc_id"), "score", 10, key="doc_id"), "doc_id")


# ---------------------------------------------------------------- entities and graph

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def entity_ctes(rows: str, key: str, text: str, tags: str, out: str) -> str:
    """CTE ``out`` (key, n, entity): islands of consecutive name words, other words on their own."""
    p = out
    return f"""{p}_w AS (SELECT {key}, unnest(r) AS raw, generate_subscripts(r, 1) AS i FROM (SELECT {key}, regexp_split_to_array(regexp_replace(coalesce({text}, ''), '^[\\s\\x0B\\x{{85}}\\p{{Z}}]+|[\\s\\x0B\\x{{85}}\\p{{Z}}]+$', '', 'g'), '[\\s\\x0B\\x{{85}}\\p{{Z}}]+') AS r FROM {rows})),
{p}_t AS (SELECT *, regexp_replace(raw, '^[^\\p{{L}}\\p{{N}}-]+|[^\\p{{L}}\\p{{N}}-]+$', '', 'g') AS w FROM {p}_w),
{p}_f AS (SELECT *, regexp_matches(w, '\\p{{N}}') AND regexp_matches(w, '\\p{{L}}') AND strlen(w) >= 3 AS ident, strlen(w) BETWEEN 2 AND 6 AND regexp_full_match(w, '\\p{{Lu}}+') AS caps,
 regexp_full_match(w, '\\p{{Lu}}[\\p{{Ll}}\\p{{N}}]*') AND lower(w) NOT IN ({_STOP}) AS name, coalesce(regexp_matches(lag(raw) OVER (PARTITION BY {key} ORDER BY i), '[.!?:;]$'), true) AS starts FROM {p}_t),
{p}_g AS (SELECT *, i - row_number() OVER (PARTITION BY {key}, name ORDER BY i) AS island FROM {p}_f),
{p}_h AS (SELECT *, sum(CASE WHEN NOT (ident OR caps) THEN 1 ELSE 0 END) OVER (PARTITION BY {key}, name, island ORDER BY i) AS begun FROM {p}_g WHERE w <> ''),
{p}_e AS (SELECT {key}, i, w AS e FROM {p}_h WHERE (ident OR caps) AND (NOT name OR begun = 0)
 UNION ALL SELECT {key}, min(i), string_agg(w, ' ' ORDER BY i) FROM {p}_h WHERE name AND begun > 0 GROUP BY {key}, island HAVING count(*) > 1 OR NOT arg_min(starts, i)
 UNION ALL SELECT {key}, generate_subscripts({tags}, 1) - 1000, unnest({tags}) FROM {rows}),
{p} AS (SELECT {key}, entity, n FROM (SELECT {key}, lower(e) AS entity, row_number() OVER (PARTITION BY {key} ORDER BY min(i)) AS n FROM {p}_e WHERE strlen(lower(e)) >= 2 GROUP BY {key}, lower(e)) WHERE n <= 16)"""


ENT = entity_ctes("mem", "id", "text", "tags", "ent")
QENT = entity_ctes("(SELECT qid, query FROM req)", "qid", "query", "[]::VARCHAR[]", "qent")


def stored_entities(s, d) -> DataFrame:
    """Derived once, as on ingest."""
    from ..sources.scratch import stored

    return stored(with_entities(s, d), "entities")


def with_entities(s, d) -> DataFrame:
    return mem(s, d).withColumn("entities", extract_entities(F.col("text"), F.col("tags")))


@query(f"WITH {MEM}, {ENT} SELECT id, string_agg(entity, '|' ORDER BY n) AS entities FROM ent GROUP BY id")
def entities_extract(s, d):
    return with_entities(s, d).select("id", F.array_join("entities", "|").alias("entities"))


@query(f"WITH {MEM}, {ENT} SELECT entity, id FROM ent")
def entity_mentions(s, d):
    return graph.mentions(with_entities(s, d)).select("entity", "id")


EDGES = "edges AS (SELECT a.entity AS src, b.entity AS dst, count(*) AS cnt FROM ent a JOIN ent b ON a.id = b.id AND a.entity <> b.entity GROUP BY ALL)"


@query(f"WITH {MEM}, {ENT}, {EDGES} SELECT src, dst, cnt FROM edges")
def entity_edges(s, d):
    return graph.edges(with_entities(s, d))


@query(f"WITH {MEM}, {ENT.replace('FROM mem', 'FROM (SELECT * FROM mem WHERE session_id <> ' + repr('s4') + ')')}, {EDGES} SELECT src, dst, cnt FROM edges")
def entity_edges_after_forget(s, d):
    m = with_entities(s, d)
    return graph.edges(oplog.without(m, m.filter("session_id = 's4'")))


@query(f"WITH {MEM}, {ENT} SELECT entity, count(*) AS cnt FROM ent GROUP BY entity ORDER BY cnt DESC, entity LIMIT 40")
def top_entities(s, d):
    return graph.top_entities(with_entities(s, d), 40)


#: Requests about entities: each session's most frequent ones, with the session's number.
GREQ = "greq AS (SELECT DISTINCT substr(session_id, 2)::BIGINT AS qid, entity FROM (SELECT session_id, entity, row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, entity) AS n FROM ent JOIN mem USING (id) GROUP BY session_id, entity) WHERE n <= 3)"
HOPS = """edf AS (SELECT entity, count(*) AS df FROM ent GROUP BY entity),
near AS (SELECT src, dst, cnt FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY cnt DESC, dst) AS n FROM edges) WHERE n <= 5),
hops AS (SELECT qid, entity, 1 / (1 + ln(1 + df)) AS weight, 0 AS hop FROM greq JOIN edf USING (entity)
 UNION ALL SELECT qid, dst, 0.3 / (1 + ln(1 + df)) * ln(1 + cnt), 1 FROM greq JOIN near ON src = greq.entity JOIN edf ON edf.entity = dst)"""


def _graph_requests(m: DataFrame) -> DataFrame:
    e = m.select("session_id", F.explode("entities").alias("entity")).groupBy("session_id", "entity").count()
    e = e.withColumn("n", F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("count"), "entity"))).filter("n <= 3")
    return e.select(F.substring("session_id", 2, 9).cast("long").alias("qid"), "entity")


def _related_sql(where: str) -> str:
    return f"WITH {MEM}, {ENT}, {EDGES}, {GREQ}, {HOPS}, rel AS (SELECT qid, id, sum(weight) AS s FROM ent JOIN hops USING (entity) WHERE {where} GROUP BY qid, id) {ranked_sql('rel', 'id', 20)}"


for _name, _hop in (("graph_direct", 0), ("graph_one_hop", 1), ("graph_related", None)):
    query(_related_sql("true" if _hop is None else f"hop = {_hop}"), _name)(lambda s, d, h=_hop: _hits(graph.related_topk(_graph_requests(m := stored_entities(s, d)), m, 20, hop=h), "id"))


# ---------------------------------------------------------------- embedding, chunks

def hashed_ctes(rows: str, key: str, text: str, out: str) -> str:
    """CTE ``out`` (key, b, v): sparse unit vectors."""
    tok = TOK.format(text)
    return f"""{out}_t AS (SELECT {key}, {tok} AS t FROM {rows}),
{out}_f AS (SELECT {key}, w AS f, 1.0::DOUBLE AS x FROM (SELECT {key}, unnest(t) AS w FROM {out}_t)
 UNION ALL SELECT {key}, '#' || substr(w, i::INT, 3), 0.4 FROM (SELECT {key}, w, unnest(range(1, length(w) - 1)) AS i FROM (SELECT {key}, unnest(t) AS w FROM {out}_t) WHERE length(w) > 3)
 UNION ALL SELECT {key}, t[i::INT] || '_' || t[i::INT + 1], 0.7 FROM (SELECT {key}, t, unnest(range(1, len(t))) AS i FROM {out}_t)),
{out}_h AS (SELECT {key}, ('0x' || substr(md5(f), 1, 8))::BIGINT % 256 AS b, x * CASE WHEN substr(md5(f), 9, 1) < '8' THEN 1 ELSE -1 END AS x FROM {out}_f),
{out}_s AS (SELECT {key}, b, sum(x) AS x FROM {out}_h GROUP BY ALL),
{out} AS (SELECT {key}, b, x / n AS v FROM {out}_s JOIN (SELECT {key}, sqrt(sum(x * x)) AS n FROM {out}_s GROUP BY {key}) USING ({key}) WHERE n > 0)"""


@query(f"WITH {hashed_ctes('benchmark', 'item_id', 'text', 'hv')} SELECT item_id, b AS pos, round(v, 6) AS x FROM hv WHERE round(v, 6) <> 0")
def hash_embed_query(s, d):
    e = table(s, d, "benchmark").select("item_id", F.posexplode(hash_embed(F.col("text"))).alias("pos", "x"))
    return e.select("item_id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x")).filter("x <> 0")


QUERIES["hash_embed"], ORACLES["hash_embed"] = QUERIES.pop("hash_embed_query"), ORACLES.pop("hash_embed_query")


@query("SELECT item_id, 'query: ' || text AS as_query, 'passage: ' || text AS as_passage FROM benchmark")
def prefixing(s, d):
    return table(s, d, "benchmark").select("item_id", tx.prefixed(F.col("text"), "query: ").alias("as_query"), tx.prefixed(F.col("text"), "passage: ").alias("as_passage"))


@query()
def hash_embed_documents(s, d):
    """Of all documents, those without tokens left out: their vector is zero."""
    e = table(s, d, "documents").select("doc_id", F.posexplode(hash_embed(F.col("text"))).alias("pos", "x"))
    return e.select("doc_id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x")).filter("x <> 0")


@query("SELECT doc_id, 'query: ' || text AS as_query, 'passage: ' || text AS as_passage FROM documents")
def prefixing_documents(s, d):
    return table(s, d, "documents").select("doc_id", tx.prefixed(F.col("text"), "query: ").alias("as_query"), tx.prefixed(F.col("text"), "passage: ").alias("as_passage"))


@query("WITH e AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'soon' ELSE strftime(ts, '%b %d, %Y, %H:%M:%S') END AS stamp FROM events) SELECT event_id, stamp, epoch_us(try_strptime(stamp, '%b %d, %Y, %H:%M:%S')) // 1000 AS ms FROM e")
def stamp_to_ms(s, d):
    stamp = F.when(F.col("event_id") % 7 == 0, "soon").otherwise(F.date_format(F.col("ts").cast("timestamp"), STAMP))
    return table(s, d, "events").select("event_id", stamp.alias("stamp")).withColumn("ms", to_ms(F.col("stamp")))


@query("""WITH p AS (SELECT page_id, trim(regexp_replace(html, '\\s+', ' ', 'g')) AS t FROM pages), c AS (SELECT page_id, t, unnest(range(0, length(t), 680)) AS place FROM p)
SELECT page_id, place::INT AS place, substr(t, place + 1, 800) AS chunk FROM c WHERE length(substr(t, place + 1, 800)) > 100""")
def chunk_text(s, d):
    p = table(s, d, "pages").select("page_id", tx.squeezed(F.col("html")).alias("t"))
    c = p.select("page_id", F.posexplode(tx.chunks(F.col("t"))).alias("n", "chunk"))
    return c.filter(F.char_length("chunk") > 100).select("page_id", (F.col("n") * 680).alias("place"), "chunk")


# ---------------------------------------------------------------- recall


#: Where the memories of (application, folder) were derived.
_DERIVED: dict[tuple[str, str], DataFrame] = {}


def searchable(s, d) -> DataFrame:
    """Memories with entities and vectors, derived once an application and stored, as on ingest: the legs read columns, not texts."""
    from ..sources.scratch import stored

    place = s.sparkContext.applicationId, d
    if place not in _DERIVED:
        # the fixture is one small file: dealt out, so that all cores embed
        dealt = mem(s, d).repartition(s.sparkContext.defaultParallelism, "id")
        _DERIVED[place] = stored(dealt.withColumn("entities", extract_entities(F.col("text"), F.col("tags"))).withColumn("embedding", hash_embed(F.col("text"))), "memories")
    return _DERIVED[place]


def requests(s, d, strategy: str = "balanced", **extra) -> DataFrame:
    r = bench(s, d).withColumn("strategy", F.lit(strategy))
    for name, value in extra.items():
        r = r.withColumn(name, value)
    return r


def recall_ctes(live: str = "true", asof: str = "true", strategy: str = "balanced", mem_rows: str = "mem") -> str:
    """CTE ``scored`` (qid, id, signals, s). ``live``: on a memory m; ``asof``: on m and the request r."""
    v, lx, g, rc = STRATEGIES[strategy]
    return f"""{MEM}, {REQ}, ok AS (SELECT r.qid, m.id FROM req r, mem m WHERE ({live}) AND ({asof}) AND (m.expires_at IS NULL OR m.expires_at > {NOW_MS})),
{hashed_ctes('mem', 'id', 'text', 'mv')}, {hashed_ctes('req', 'qid', 'query', 'qv')},
vdot AS (SELECT qid, id, coalesce(sum(mv.v * qv.v), 0) AS s FROM ok LEFT JOIN qv USING (qid) LEFT JOIN mv USING (id, b) GROUP BY qid, id),
vleg AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, id) AS rank FROM vdot),
{bm25_ctes('mem', 'id', tag='m')}, lleg AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, id) AS rank FROM bm25m SEMI JOIN ok USING (qid, id)),
{ENT}, {EDGES}, {QENT}, greq AS (SELECT DISTINCT qid, entity FROM qent), {HOPS},
rel AS (SELECT qid, id, sum(weight) AS s FROM ent JOIN hops USING (entity) GROUP BY qid, id),
gleg AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, id) AS rank FROM rel SEMI JOIN ok USING (qid, id)),
u AS (SELECT qid, id, 1 / (60.0 + rank) AS vector, 0.0 AS lexical, 0.0 AS graph FROM vleg WHERE rank <= 100
 UNION ALL SELECT qid, id, 0, 1 / (60.0 + rank), 0 FROM lleg WHERE rank <= 100 UNION ALL SELECT qid, id, 0, 0, 1 / (60.0 + rank) FROM gleg WHERE rank <= 100),
fused AS (SELECT qid, id, max(vector) AS vector, max(lexical) AS lexical, max(graph) AS graph FROM u GROUP BY qid, id),
sig AS (SELECT fused.*, m.text, exp(-greatest({NOW_MS} - m.created_at, 0) * ln(2.0) / 604800000.0) AS recency, 0.005 * m.importance AS importance FROM fused JOIN mem m USING (id)),
scored AS (SELECT *, {v} * vector + {lx} * lexical + {g} * graph + {rc} * recency / 60.0 + importance AS s FROM sig)"""


SIGNALS = ("vector", "lexical", "graph", "recency", "importance")


def recall_sql(k: int = 10, **options) -> str:
    rounded = ", ".join(f"round({c}, 6) AS {c}" for c in SIGNALS)
    return f"WITH {recall_ctes(**options)} SELECT qid, rank, id, round(s, 6) AS score, {rounded} FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, id) AS rank FROM scored) WHERE rank <= {k}"


def _recalled(df: DataFrame, *more: str) -> DataFrame:
    return df.select("qid", "rank", "id", *[F.round(c, 6).alias(c) for c in ("score", *SIGNALS, *more)])


for _strategy in STRATEGIES:
    query(recall_sql(strategy=_strategy), f"recall_{_strategy}")(lambda s, d, t=_strategy: _recalled(plan.recall(requests(s, d, t), searchable(s, d), NOW_MS)))


@query(recall_sql(3))
def recall_topk(s, d):
    return _recalled(plan.recall(requests(s, d, top_k=F.lit(3)), searchable(s, d), NOW_MS))


@query(recall_sql(live="m.kind IN ('episodic', 'semantic') AND list_contains(m.tags, 'u1') AND (m.visibility = 'shared' OR m.agent_id IS NULL OR m.agent_id = 'planner')"))
def recall_prefiltered(s, d):
    r = requests(s, d, kinds=F.array(F.lit("episodic"), F.lit("semantic")), tags=F.array(F.lit("u1")), as_agent=F.lit("planner"))
    return _recalled(plan.recall(r, searchable(s, d), NOW_MS))


@query(recall_sql(asof="m.created_at <= 1704067200000 + r.qid * 7200000"))
def recall_as_of(s, d):
    """Each request sees only what was there at its own time."""
    return _recalled(plan.recall(requests(s, d, until=F.lit(1_704_067_200_000) + F.col("qid") * 7_200_000), searchable(s, d), NOW_MS))


@query(f"""WITH {recall_ctes()}, pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, id) AS place FROM scored) WHERE place <= 30),
marked AS (SELECT pool.*, len(list_intersect(list_distinct({TOK.format('query')}), list_distinct({TOK.format('text')}))) / greatest(len(list_distinct({TOK.format('query')})), 1) AS rerank FROM pool JOIN req USING (qid))
SELECT qid, rank, id, round(s, 6) AS score, {', '.join(f'round({c}, 6) AS {c}' for c in (*SIGNALS, 'rerank'))} FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rerank DESC, round(s, 9) DESC, id) AS rank FROM marked) WHERE rank <= 10""")
def recall_reranked(s, d):
    return _recalled(plan.recall(requests(s, d), searchable(s, d), NOW_MS, reranker=keyword_reranker), "rerank")


@query(f"WITH {recall_ctes()} SELECT qid, id, round(vector, 9) AS vector, round(lexical, 9) AS lexical, round(graph, 9) AS graph FROM fused")
def rrf_fusion(s, d):
    m, r = searchable(s, d), plan.complete(requests(s, d))
    legs = {"vector": plan.vector_leg(r, m, NOW_MS), "lexical": plan.lexical_leg(r, m, NOW_MS), "graph": plan.graph_leg(r, m, NOW_MS)}
    return fuse(legs).select("qid", "id", *[F.round(c, 9).alias(c) for c in legs])


@query(f"SELECT event_id, round(exp(-greatest({NOW_MS} - epoch_us(ts) // 1000, 0) * ln(2.0) / 604800000.0), 6) AS recency FROM events")
def recency_decay(s, d):
    e = table(s, d, "events").withColumn("ms", F.expr("unix_micros(cast(ts AS timestamp)) div 1000"))
    return e.select("event_id", F.round(recency(F.col("ms"), NOW_MS), 6).alias("recency"))


@query(f"WITH {recall_ctes()}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, id) AS rank FROM scored) WHERE rank <= 10) SELECT qid, rank, id, {', '.join(f'round(CASE WHEN max({c}) OVER w > 0 THEN {c} / max({c}) OVER w ELSE 0 END, 6) AS {c}' for c in SIGNALS[:3])}, round(recency, 6) AS recency FROM top WINDOW w AS (PARTITION BY qid)")
def signals_normalised(s, d):
    hits, w = plan.recall(requests(s, d), searchable(s, d), NOW_MS), W.partitionBy("qid")
    share = lambda c: F.round(F.when(F.max(c).over(w) > 0, F.col(c) / F.max(c).over(w)).otherwise(0.0), 6).alias(c)
    return hits.select("qid", "rank", "id", *map(share, SIGNALS[:3]), F.round("recency", 6).alias("recency"))


@query(f"WITH {recall_ctes()} SELECT qid, string_agg('[' || rank || '] ' || text, chr(10) ORDER BY rank) AS context FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, id) AS rank FROM scored) WHERE rank <= 10 GROUP BY qid")
def context_assembly(s, d):
    m = searchable(s, d)
    hits = plan.recall(requests(s, d), m, NOW_MS).select("qid", "rank", "id").join(m.select("id", "text"), "id")
    rows = F.array_sort(F.collect_list(F.struct("rank", "text")))
    return hits.groupBy("qid").agg(F.array_join(F.transform(rows, lambda r: F.concat(F.lit("["), r["rank"], F.lit("] "), r["text"])), "\n").alias("context"))


ANSWERS = "a AS (SELECT b.item_id AS qid, d.doc_id, CASE WHEN b.item_id % 2 = 0 THEN 'even' ELSE 'odd' END AS probe FROM benchmark b, documents d WHERE contains(d.text, b.text))"


@query(f"WITH {REQ}, {bm25_ctes()}, r AS ({ranked_sql('bm25', 'doc_id', 5)}), {ANSWERS} SELECT probe, count(DISTINCT a.qid) AS n, round(count(DISTINCT CASE WHEN r.doc_id IS NOT NULL THEN a.qid END) / count(DISTINCT a.qid), 6) AS hit_rate FROM a LEFT JOIN r ON r.qid = a.qid AND r.doc_id = a.doc_id GROUP BY probe")
def hit_at_k(s, d):
    """Of BM25; the right answers to a passage are the documents that hold it."""
    docs = table(s, d, "documents")
    hits = lexical.bm25_topk(bench(s, d), docs, 10, "doc_id")
    # the stated requests as one array, beside every document
    passages = bench(s, d).agg(F.collect_list(F.struct("qid", "query")).alias("p"))
    held = docs.select("doc_id", "text", passages.scalar().alias("p")).select("doc_id", F.explode(F.filter("p", lambda p: F.contains("text", p["query"]))).alias("p"))
    answers = held.select(F.col("p.qid").alias("qid"), "doc_id", F.when(F.col("p.qid") % 2 == 0, "even").otherwise("odd").alias("probe"))
    return aggregates.hit_at_k(hits, answers, 5, "doc_id").select("probe", "n", F.round("hit_rate", 6).alias("hit_rate"))


# ---------------------------------------------------------------- aggregates


@query(f"WITH {MEM}, {ENT} SELECT count(*) AS total_memories, count(*) AS vector_indexed, count(text) AS lexical_indexed, 256 AS vector_dim, (SELECT count(DISTINCT entity) FROM ent) AS entities, false AS quantized, 3::BIGINT AS wal_tail_ops FROM mem")
def stats(s, d):
    return aggregates.stats(searchable(s, d), 3)


_EDGES = aggregates.EDGES


@query("WITH e AS (SELECT event_type, value / 1000.0 AS s FROM events), b AS (SELECT unnest([" + ", ".join(f"{e}::DOUBLE" for e in _EDGES) + ", 'inf'::DOUBLE]) AS edge, unnest([" + ", ".join(f"'{e}'" for e in _EDGES) + ", '+Inf']) AS le) SELECT event_type, le, count(*) FILTER (s <= edge) AS cnt, count(s) AS total, round(sum(s), 6) AS sum_seconds FROM e, b GROUP BY event_type, le")
def latency_histogram(s, d):
    h = aggregates.latency_histogram(table(s, d, "events"), F.col("value") / 1000.0, "event_type")
    return h.select("event_type", "le", "cnt", "total", F.round("sum_seconds", 6).alias("sum_seconds"))


STATUS = "CASE user_id % 10 WHEN 0 THEN 401 WHEN 1 THEN 403 WHEN 2 THEN 500 ELSE 200 END"


@query(f"SELECT event_type, {STATUS} AS status, count(*) AS cnt, {STATUS} IN (401, 403) AS rejected FROM events GROUP BY ALL")
def request_counts(s, d):
    return aggregates.request_counts(table(s, d, "events").withColumn("status", F.expr(STATUS)), "event_type", "status")


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def latency_percentiles(s, d):
    return aggregates.percentiles(table(s, d, "events"), "value", "event_type").select("event_type", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query("""WITH l AS (SELECT CASE WHEN doc_id % 11 = 0 THEN 'Error' WHEN quality = 1 AND toxic = 0 THEN 'Correct' WHEN toxic = 1 THEN 'Hallucination' ELSE 'Omission' END AS verdict, doc_id % 4 AS kind FROM labels)
SELECT kind, count(*) AS n, round(avg((verdict = 'Correct')::INT), 4) AS correct, round(avg((verdict = 'Hallucination')::INT), 4) AS hallucination, round(avg((verdict = 'Omission')::INT), 4) AS omission FROM l WHERE verdict <> 'Error' GROUP BY kind""")
def verdict_breakdown(s, d):
    v = F.when(F.col("doc_id") % 11 == 0, "Error").when((F.col("quality") == 1) & (F.col("toxic") == 0), "Correct").when(F.col("toxic") == 1, "Hallucination").otherwise("Omission")
    return aggregates.verdicts(table(s, d, "labels").select(v.alias("verdict"), (F.col("doc_id") % 4).alias("kind")), "verdict", "kind")


# ---------------------------------------------------------------- lifecycle


@query(M + f"SELECT id FROM mem WHERE expires_at <= {NOW_MS}")
def ttl_sweep(s, d):
    return lifecycle.expired(mem(s, d), NOW_MS).select("id")


CAND = f"cand AS (SELECT * FROM mem WHERE kind = 'episodic' AND created_at <= {NOW_MS} - 604800000 AND (expires_at IS NULL OR expires_at > {NOW_MS}))"
BATCH = """numbered AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at, id) - 1 AS n FROM cand), sized AS (SELECT *, (n // 12)::INT AS batch, (n % 12)::INT AS place, count(*) OVER (PARTITION BY session_id, n // 12) AS size FROM numbered), batched AS (SELECT * FROM sized WHERE size >= 4)"""


@query(f"WITH {MEM}, {CAND} SELECT id, session_id FROM cand")
def consolidation_candidates(s, d):
    return lifecycle.candidates(mem(s, d), NOW_MS).select("id", "session_id")


@query(f"WITH {MEM}, {CAND}, {BATCH} SELECT session_id, batch, place, id FROM batched")
def consolidation_batches(s, d):
    return lifecycle.batches(lifecycle.candidates(mem(s, d), NOW_MS)).select("session_id", "batch", "place", "id")


@query(f"""WITH {MEM}, {CAND}, {BATCH}, tags AS (SELECT session_id, batch, tag, min(place * 10 + i) AS first FROM (SELECT session_id, batch, place, unnest(tags) AS tag, generate_subscripts(tags, 1) AS i FROM batched) GROUP BY ALL),
best AS (SELECT session_id, batch, string_agg(tag, ',' ORDER BY first) AS tags FROM (SELECT *, row_number() OVER (PARTITION BY session_id, batch ORDER BY first) AS n FROM tags) WHERE n <= 8 GROUP BY ALL)
SELECT session_id, batch, 'semantic' AS kind, max(importance) AS importance, string_agg(id, ',' ORDER BY place) AS sources, any_value(agent_id) FILTER (place = 0) AS agent_id, any_value(best.tags) AS tags,
 CASE WHEN bool_and(visibility = 'shared') THEN 'shared' ELSE 'private' END AS visibility, count(*) AS count, min(created_at) AS from_ms, max(created_at) AS to_ms FROM batched JOIN best USING (session_id, batch) GROUP BY session_id, batch""")
def consolidated_records(s, d):
    rows = lifecycle.consolidated(lifecycle.batches(lifecycle.candidates(mem(s, d), NOW_MS)), NOW_MS)
    return rows.select("session_id", "batch", "kind", "importance", F.array_join("sources", ",").alias("sources"), "agent_id", F.array_join("tags", ",").alias("tags"), "visibility", "count", "from_ms", "to_ms")


@query(f"""WITH {MEM}, {CAND}, {BATCH}, tk AS (SELECT session_id, batch, place, {TOK.format('text')} AS t FROM batched), df AS (SELECT session_id, batch, term, count(*) AS df FROM (SELECT session_id, batch, unnest(list_distinct(t)) AS term FROM tk) GROUP BY ALL),
sums AS (SELECT session_id, batch, place, sum(df) AS total FROM (SELECT session_id, batch, place, unnest(list_distinct(t)) AS term FROM tk) JOIN df USING (session_id, batch, term) GROUP BY ALL)
SELECT tk.session_id, tk.batch, tk.place, round(coalesce(total, 0) / (len(t) + 3.0), 6) AS score FROM tk LEFT JOIN sums USING (session_id, batch, place)""")
def summary_scores(s, d):
    rows = lifecycle.central(lifecycle.batches(lifecycle.candidates(mem(s, d), NOW_MS)))
    return rows.select("session_id", "batch", "place", F.round("score", 6).alias("score"))


@query()
def extractive_summary(s, d):
    return lifecycle.summaries(lifecycle.batches(lifecycle.candidates(mem(s, d), NOW_MS)))


# ---------------------------------------------------------------- ingest


@query("SELECT conv_id, turn, role || ': ' || text AS text, 'episodic' AS kind FROM conversations")
def ingest_raw_turns(s, d):
    return ingest.raw_turns(table(s, d, "conversations")).select("conv_id", "turn", "text", "kind")


@query(f"WITH c AS (SELECT vec_id AS qid, embedding AS qe FROM embeddings WHERE vec_id % 50 = 0), x AS (SELECT qid, max(round({DOT}, 9)) AS best FROM c, embeddings WHERE vec_id <> qid AND label < 5 GROUP BY qid) SELECT qid FROM x WHERE best < 0.8")
def dedup_existing(s, d):
    """The stated candidates against all other rows. The SQL looks at the first five labels alone; it is the same while no row of another label is as near."""
    live = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return ingest.new_facts(probes(s, d), live, 0.8, live_already=True).select("qid")


@query()
def dedup_greedy(s, d):
    e = table(s, d, "embeddings").select(F.col("label").cast("string").alias("exchange"), F.col("vec_id").alias("place"), "embedding")
    return ingest.greedy_distinct(e, 0.9).select("exchange", "place")


@query("""WITH c AS (SELECT conv_id, count(*) AS raw, count(*) FILTER (role = 'assistant') AS facts, count(DISTINCT CASE WHEN role = 'assistant' THEN text END) AS distinct_facts FROM conversations GROUP BY conv_id)
SELECT conv_id, raw, facts > 0 AS extraction_ran, distinct_facts AS facts, facts - distinct_facts AS duplicates FROM c""")
def ingest_report(s, d):
    """Reports of all conversations, an assistant's turn standing for a fact; equal texts have equal vectors and are duplicates."""
    c = table(s, d, "conversations")
    facts = c.filter("role = 'assistant'").withColumn("embedding", hash_embed(F.col("text")))
    kept = ingest.greedy_distinct(facts, 0.999999, group="conv_id", order="turn")
    return ingest.reports(c, facts, kept, "conv_id").select("conv_id", "raw", "extraction_ran", "facts", "duplicates")


@query()
def parse_candidates(s, d):
    """A scripted extractor that answers with each conversation's turns as facts, in prose and a fence."""
    c = table(s, d, "conversations").groupBy(F.col("conv_id").cast("string").alias("exchange")).agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("turns"))
    said = c.select("exchange", F.to_json(F.transform("turns", lambda t: F.struct(t["text"].alias("text"), F.lit("semantic").alias("kind")))).alias("conversation"), F.array().cast("array<string>").alias("known"))
    return ingest.candidates_of(said, lambda conversation, known: f"Facts:\n```json\n{conversation}\n```")
