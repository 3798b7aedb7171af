"""Streams: requests and turns into a collection, periodic lifecycle runs, rolling request metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..api import Engine
from ..operators.records import REQUEST_COLUMNS, validated


def request_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Requests that arrive as JSON-lines files."""
    return spark.readStream.schema(", ".join(f"`{n}` {k}" for n, k in REQUEST_COLUMNS.items())).json(folder)


def remember_stream(requests: DataFrame, engine: Engine, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Each micro-batch becomes one batch of operations; invalid requests are left out, as no caller can be told.

    A batch and its number are committed together: one that is replayed after a failure is recognised and skipped.
    """

    def apply(batch: DataFrame, number: int) -> None:
        seen = engine.store.manifest().get("streamed", {})
        if seen.get(checkpoint, -1) >= number:
            return
        good = validated(batch).filter("problem IS NULL").drop("problem")
        mark = {"streamed": seen | {checkpoint: number}}
        if good.limit(1).count():
            engine.remember_batch(good, **mark)
        else:
            engine.store.commit(**mark)

    return requests.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def lifecycle_stream(spark: SparkSession, engines, checkpoint: str, every: str = "300 seconds") -> StreamingQuery:
    """A lifecycle run of every open engine at each tick."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def apply(_: DataFrame, number: int) -> None:
        if number:  # the first tick comes at the start
            for engine in list(engines()):
                engine.run_lifecycle()

    return ticks.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def request_rates(events: DataFrame, ts: str = "ts", by: str = "event_type", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Requests and mean value per window and type; late rows are taken up to a watermark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), by, "n", "mean")
