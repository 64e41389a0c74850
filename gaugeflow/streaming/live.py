"""Continuous forms of the live state, registry, session counters and trends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from gaugeflow.operators.live import graph_snapshot, latest_readings, node_status
from gaugeflow.operators.registry import sensor_registry
from gaugeflow.operators.storage import session_stats


def deduplicated(stream: DataFrame, delay: str = "10 minutes", ts: str = "ts", ids=("msg_id",)) -> DataFrame:
    """Drops repeated deliveries; ids are remembered for the watermark delay only."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(ids))


def latest_stream(stream: DataFrame) -> DataFrame:
    """Latest reading per equipment and sensor, one state row per key (update or complete mode)."""
    return latest_readings(stream)


def registry_stream(analyzed: DataFrame) -> DataFrame:
    return sensor_registry(analyzed)


def session_stream(messages: DataFrame) -> DataFrame:
    return session_stats(messages)


def trend_stream(stream: DataFrame, interval: str = "10 minutes", delay: str = "10 minutes", by=("cell_id", "subtopic")) -> DataFrame:
    """Tumbling averages; in append mode a bucket comes out once the watermark has passed it."""
    r = F.col("reading")
    return (
        stream.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", delay)
        .groupBy(*by, F.window("ts", interval).alias("w"))
        .agg(F.avg(r).alias("mean_value"), F.min(r).alias("min_value"), F.max(r).alias("max_value"), F.count(r).alias("data_point_count"))
        .select(*by, F.col("w.start").alias("bucket"), "mean_value", "min_value", "max_value", "data_point_count")
    )


def emit_graph_updates(
    stream: DataFrame, layout: DataFrame, edges: DataFrame, push: Callable[[DataFrame, int], None], checkpoint: str, interval: str = "500 milliseconds", available_now: bool = False
):
    """Pushes the whole graph after each trigger, so at most once per interval.

    The latest values live in the state store; ``push`` gets the snapshot of a
    batch as rows.
    """

    def snapshot(latest: DataFrame, batch: int) -> None:
        push(graph_snapshot(node_status(latest, layout), edges), batch)

    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    writer = latest_stream(stream).writeStream.outputMode("complete").foreachBatch(snapshot)
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()
