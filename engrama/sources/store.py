"""Versioned storage of a memory collection, in any folder Spark can write.

``log/`` holds operations, one append per batch; ``snapshots/v<N>/`` the folded records of a checkpoint; ``manifest/m<N>.json``
says which snapshot counts and from which seq on the log is the tail. A manifest is one small file, written whole and then
renamed by Hadoop's file system; readers take the largest number. Nothing is changed in place, so readers are never blocked.
There is one writer at a time.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.oplog import OPLOG, fold
from ..schema import MEMORY


class Files:
    """The few file operations that are needed, through Hadoop: local, HDFS and object stores alike."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self._path(name))

    def list(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(name))) if self.exists(name) else []

    def write(self, name: str, text: str) -> None:
        """Written aside and renamed: it is there whole or not at all."""
        aside = self._path(name + ".tmp")
        out = self.fs.create(aside, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not self.fs.rename(aside, self._path(name)):
            raise OSError(f"could not commit {name}")

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def delete(self, name: str = "") -> bool:
        return self.fs.delete(self._path(name), True)


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.files = Files(spark, root)

    def manifest(self) -> dict:
        found = [n for n in self.files.list("manifest") if n.endswith(".json")]
        return json.loads(self.files.read(f"manifest/{found[-1]}")) if found else {"version": 0, "snapshot": None, "tail": 0, "next": 1, "generation": 0}

    def commit(self, **changes) -> dict:
        now = self.manifest()
        new = now | changes | {"version": now["version"] + 1}
        self.files.write(f"manifest/m{new['version']:012d}.json", json.dumps(new))
        return new

    def _log(self, generation: int) -> str:
        return f"{self.root}/log/g{generation:06d}"

    def append(self, ops: DataFrame, seqs: int = 1, **marks) -> int:
        """One job and one commit per batch; the batch shows only with the commit, and ``marks`` with it. ``seqs``: how many numbers it takes."""
        m = self.manifest()
        first = m["next"]
        rows = ops.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in OPLOG])
        # what an uncommitted attempt may have left under this number goes
        rows.write.mode("overwrite").parquet(f"{self._log(m['generation'])}/batch={first:012d}")
        self.commit(next=first + seqs, **marks)
        return first

    def tail(self) -> DataFrame:
        """Committed operations since the last checkpoint. A batch whose commit failed is not seen, and its numbers are taken by the next."""
        m = self.manifest()
        name = f"log/g{m['generation']:06d}"
        batches = [b for b in self.files.list(name) if m["tail"] <= int(b.split("=")[1]) < m["next"]]
        if not batches:
            return self.spark.createDataFrame([], OPLOG)
        return self.spark.read.schema(OPLOG).parquet(*[f"{self.root}/{name}/{b}" for b in batches])

    def base(self) -> DataFrame:
        m = self.manifest()
        return self.spark.read.schema(MEMORY).parquet(f"{self.root}/{m['snapshot']}") if m["snapshot"] else self.spark.createDataFrame([], MEMORY)

    def live(self) -> DataFrame:
        """Checkpoint and tail folded. Rows that the tail does not touch skip the fold's shuffle of records."""
        m = self.manifest()
        if not m["snapshot"]:
            return fold(self.tail())
        tail = self.tail()
        touched = tail.select("id").distinct()
        base = self.base()
        record = F.struct(*[F.col(f.name) for f in MEMORY])
        again = base.join(touched, "id", "left_semi").select(F.lit(0).cast("long").alias("seq"), F.lit("remember").alias("op"), "id", record.alias("record"), F.lit(None).cast("array<string>").alias("sources"))
        return base.join(touched, "id", "left_anti").unionByName(fold(again.unionByName(tail)))

    def checkpoint(self) -> dict:
        """Fold, write a new snapshot and start a new log generation; the old ones stay until ``vacuum``."""
        m = self.manifest()
        name = f"snapshots/v{m['version'] + 1:012d}"
        self.live().write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.commit(snapshot=name, tail=m["next"], generation=m["generation"] + 1)

    def vacuum(self) -> None:
        """Drop snapshots, indexes, logs and manifests that no current reader starts from."""
        m = self.manifest()
        for name in self.files.list("snapshots"):
            if f"snapshots/{name}" != m["snapshot"]:
                self.files.delete(f"snapshots/{name}")
        for name in self.files.list("index"):
            if f"index/{name}" != m.get("index"):
                self.files.delete(f"index/{name}")
        for name in self.files.list("log"):
            if int(name[1:]) < m["generation"]:
                self.files.delete(f"log/{name}")
        for name in self.files.list("manifest"):
            if name < f"m{m['version']:012d}.json":
                self.files.delete(f"manifest/{name}")


def read_json_log(spark: SparkSession, path: str) -> DataFrame:
    """Operations of JSON lines; blank and unreadable lines are left out."""
    from pyspark.sql import types as T

    schema = T.StructType([*OPLOG.fields, T.StructField("_bad", T.StringType())])
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.filter(F.col("_bad").isNull() & F.col("op").isNotNull()).drop("_bad")


def write_json_log(ops: DataFrame, path: str) -> None:
    ops.write.mode("append").json(path)


def write_snapshot(rows: DataFrame, path: str) -> None:
    """A portable export: JSON lines of records."""
    rows.write.mode("overwrite").json(path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MEMORY).json(path)
