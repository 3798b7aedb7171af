"""The memory record, its constants, and the fixture view that tests derive from conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("episodic", "semantic", "working", "reflection", "tool_call", "procedural")

#: Fixed values that define results.
RRF_K = 60.0
CANDIDATES = 100
TOP_K = 10
HALF_LIFE_MS = 604_800_000
IMPORTANCE_WEIGHT = 0.005
BM25_K1, BM25_B = 1.2, 0.75
HOP_WEIGHT, HOP_NEIGHBOURS = 0.3, 5
RERANK_POOL = 3
DEDUP_COSINE = 0.95
KNOWN_FACTS, SUPERSEDE_NEIGHBOURS, MOST_FACTS = 12, 5, 12
WORKING_TTL_S, CONSOLIDATE_AFTER_S, BATCH_MIN, BATCH_MAX = 86_400, 604_800, 4, 12
SUMMARY_BYTES, SUMMARY_TAGS = 500, 8
CHECKPOINT_OPS = 1000
LEAST_CREATED_MS = 100_000_000_000
SQ8_FROM_DIM = 1024

#: strategy -> weights of vector, lexical, graph and recency
STRATEGIES = {
    "balanced": (1.0, 1.0, 0.7, 0.3),
    "semantic": (1.0, 0.3, 0.5, 0.1),
    "lexical": (0.3, 1.0, 0.5, 0.1),
    "recent": (0.5, 0.5, 0.3, 1.2),
    "relational": (0.4, 0.4, 1.2, 0.2),
}

MEMORY = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("created_at", T.LongType()),
    T.StructField("importance", T.DoubleType()),
    T.StructField("expires_at", T.LongType()),
    T.StructField("sources", T.ArrayType(T.StringType())),
    T.StructField("entities", T.ArrayType(T.StringType())),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("session_id", T.StringType()),
    T.StructField("agent_id", T.StringType()),
    T.StructField("visibility", T.StringType()),
    T.StructField("metadata", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.DoubleType())),
])

REQUEST = "qid long, query string, strategy string, as_agent string, kinds array<string>, tags array<string>, session_id string, agent_id string, since long, until long, top_k int, query_embedding array<double>"

#: The fixture's clock, 2024-01-31.
NOW_MS = 1_706_659_200_000


def fixture_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories made of the turns of ``conversations``."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    created = F.lit(1_704_067_200_000) + F.col("conv_id") * 3_600_000 + F.col("turn") * 60_000
    return c.select(
        F.concat(F.lit("m"), "conv_id", F.lit("-"), "turn").alias("id"),
        F.when(F.col("role") == "user", "episodic").when(F.col("role") == "assistant", "semantic").otherwise("procedural").alias("kind"),
        "text",
        created.alias("created_at"),
        (((F.col("conv_id") * 7 + F.col("turn") * 3) % 11) / F.lit(10.0)).alias("importance"),
        F.when((F.col("conv_id") + F.col("turn")) % 6 == 0, created + F.lit(86_400_000) * (F.col("conv_id") % 40)).alias("expires_at"),
        F.concat(F.lit("s"), F.col("conv_id") % 25).alias("session_id"),
        F.when(F.col("conv_id") % 3 == 1, "planner").when(F.col("conv_id") % 3 == 2, "researcher").alias("agent_id"),
        F.when((F.col("conv_id") % 3 == 0) | (F.col("turn") % 2 == 0), "shared").otherwise("private").alias("visibility"),
        F.array(F.concat(F.lit("t"), F.col("conv_id") % 5), F.concat(F.lit("u"), F.col("turn") % 3)).alias("tags"),
    )


#: The same view for the oracle.
MEMORIES_SQL = """mem AS (SELECT 'm' || conv_id || '-' || turn AS id,
  CASE role WHEN 'user' THEN 'episodic' WHEN 'assistant' THEN 'semantic' ELSE 'procedural' END AS kind, text,
  1704067200000 + conv_id * 3600000 + turn * 60000 AS created_at, ((conv_id * 7 + turn * 3) % 11) / 10.0::DOUBLE AS importance,
  CASE WHEN (conv_id + turn) % 6 = 0 THEN 1704067200000 + conv_id * 3600000 + turn * 60000 + 86400000 * (conv_id % 40) END AS expires_at,
  's' || (conv_id % 25) AS session_id, CASE conv_id % 3 WHEN 1 THEN 'planner' WHEN 2 THEN 'researcher' END AS agent_id,
  CASE WHEN conv_id % 3 = 0 OR turn % 2 = 0 THEN 'shared' ELSE 'private' END AS visibility,
  ['t' || (conv_id % 5), 'u' || (turn % 3)] AS tags FROM conversations)"""
