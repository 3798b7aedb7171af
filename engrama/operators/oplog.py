"""The operation log as data: an append-only table of ops, folded to the live records.

A row: seq, op (remember / forget / set_sources), id, record (struct), sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import MEMORY

OPLOG = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("op", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("record", MEMORY),
    T.StructField("sources", T.ArrayType(T.StringType())),
])


def remember_ops(records: DataFrame, seq: int) -> DataFrame:
    """Ops for records that have all columns of ``MEMORY``; a batch shares one seq."""
    record = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in MEMORY])
    return records.select(F.lit(seq).cast("long").alias("seq"), F.lit("remember").alias("op"), "id", record.alias("record"), F.lit(None).cast("array<string>").alias("sources"))


def forget_ops(ids: DataFrame, seq: int) -> DataFrame:
    return ids.select(F.lit(seq).cast("long").alias("seq"), F.lit("forget").alias("op"), "id", F.lit(None).cast(MEMORY).alias("record"), F.lit(None).cast("array<string>").alias("sources"))


def source_ops(rows: DataFrame, seq: int) -> DataFrame:
    """``rows``: id, sources."""
    return rows.select(F.lit(seq).cast("long").alias("seq"), F.lit("set_sources").alias("op"), "id", F.lit(None).cast(MEMORY).alias("record"), "sources")


def fold(ops: DataFrame) -> DataFrame:
    """Live records, one aggregation by id with map-side parts.

    A record lives if a remember follows its last forget; the first such counts (replay is idempotent), and sources are those of the
    last set_sources after it, else its own. Within one seq a forget comes last.
    """
    keyed = ops.withColumn("__at", F.struct("seq", F.when(F.col("op") == "forget", 2).when(F.col("op") == "set_sources", 1).otherwise(0).alias("part")))
    forgotten = keyed.filter("op = 'forget'").groupBy("id").agg(F.max("__at").alias("__gone"))
    later = keyed.filter("op <> 'forget'").join(forgotten, "id", "left").filter("__gone IS NULL OR __at > __gone")
    born = F.min_by(F.when(F.col("op") == "remember", F.col("record")), F.when(F.col("op") == "remember", F.col("__at")))
    at = F.min(F.when(F.col("op") == "remember", F.col("__at")))
    last = F.max(F.when(F.col("op") == "set_sources", F.struct("__at", "sources")))
    found = later.groupBy("id").agg(born.alias("r"), at.alias("born"), last.alias("s")).filter("r IS NOT NULL")
    sources = F.when(F.col("s.__at") > F.col("born"), F.col("s.sources")).otherwise(F.col("r.sources"))
    names = [f.name for f in MEMORY]
    return found.select(*[(sources if n == "sources" else F.col("id") if n == "id" else F.col(f"r.{n}")).alias(n) for n in names])


def without(records: DataFrame, forgotten: DataFrame) -> DataFrame:
    return records.join(forgotten.select("id").distinct(), "id", "left_anti")
