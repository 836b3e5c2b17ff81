"""Streams of alerts: counts per window, routing to sinks, exactly-once processing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQueryListener

from ..functions import scores
from ..operators import rows
from ..params import Thresholds


def with_event_time(sdf: DataFrame, late: str) -> DataFrame:
    """Add the timestamp column `at` from ts_us and a watermark; later rows than that are dropped."""
    return sdf.withColumn("at", F.timestamp_micros("ts_us")).withWatermark("at", late)


def score_stream(sdf: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Valid events with decision and severity; Ignore is dropped."""
    judged = rows.validate(sdf).withColumn("decision", scores.decide(F.col("score"), t))
    return judged.filter(F.col("decision") != "Ignore").withColumn("severity", scores.severity(F.col("score")))


def alert_counts(alerts: DataFrame, width: str = "1 minute", late: str = "1 minute", keys: tuple[str, ...] = ("tenant",)) -> DataFrame:
    """Tumbling counts per tenant, emitted once when the watermark closes a window."""
    timed = with_event_time(alerts, late)
    counts = timed.groupBy(F.window("at", width), *keys).agg(F.count(F.lit(1)).alias("alerts"), F.max("score").alias("max_score"))
    return counts.select(F.unix_micros("window.start").alias("start_us"), *keys, "alerts", "max_score")


def upsert(counts: DataFrame, out: str, state: str) -> DataStreamWriter:
    """Write every changed window after each micro-batch, so that the last windows are there without waiting for a
    watermark that may never come. A repeated batch replaces its own folder.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", state)


def current(spark: SparkSession, out: str, keys: tuple[str, ...] = ("start_us", "tenant")) -> DataFrame:
    """The newest version of each window that `upsert` has written."""
    rows = spark.read.parquet(out)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return newest.select(*keys, *[F.col(f"v.{c}").alias(c) for c in values])


def deduplicate(sdf: DataFrame, late: str, key: str = "event_id") -> DataFrame:
    """Drop repeats of an event that arrive within the watermark."""
    return with_event_time(sdf, late).dropDuplicatesWithinWatermark([key])


def process_once(sdf: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, state: str) -> DataStreamWriter:
    """Score each micro-batch and replace that batch's folder, so a repeated batch leaves no trace."""

    def write(batch: DataFrame, batch_id: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return sdf.writeStream.foreachBatch(write).option("checkpointLocation", state)


def push(
    sdf: DataFrame, sinks: dict[str, Callable[[DataFrame, int], None]], kind: str, state: str, every: str = "5 seconds"
) -> DataStreamWriter:
    """Every few seconds hand the rows of each kind (alert, log, event ...) to its sink."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for name, sink in sinks.items():
                sink(batch.filter(F.col(kind) == name), batch_id)
        finally:
            batch.unpersist()

    return sdf.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(processingTime=every)


def on_decision(alerts: DataFrame, callbacks: dict[str, Callable[[DataFrame, int], None]], state: str) -> DataStreamWriter:
    """Callbacks for alerts, blocks and escalations, one call per micro-batch and decision."""
    return push(alerts, callbacks, "decision", state)


class MetricsSink(StreamingQueryListener):
    """Calls `sink(name, batch id, rows, rows per second)` after every micro-batch."""

    def __init__(self, sink: Callable[[str, int, int, float], None]):
        self.sink = sink

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.sink(p.name, p.batchId, p.numInputRows, p.processedRowsPerSecond)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass
