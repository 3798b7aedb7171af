"""Shared storage and small helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, a folder of this machine if the session is local, else an error."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = context.getCheckpointDir()
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not named:  # a single machine, as in tests
            named = "file://" + tempfile.mkdtemp(prefix="engrama-")
            context.setCheckpointDir(named)
    elif not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new place in the shared folder. The application's folder may be removed when the application has ended."""
    return f"{shared_dir(spark)}/engrama/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """``names``, each lengthened until no column is called so: for columns that are put beside a caller's."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
        taken.add(name.lower())
    return out


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))
