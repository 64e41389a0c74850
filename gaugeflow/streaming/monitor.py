"""Live monitoring: one landing folder feeding storage, alerts and the graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugeflow.functions.fields import parse_payload
from gaugeflow.operators.analysis import analyze_messages, filter_topics, learned_keys
from gaugeflow.sources.messages import read_messages, split_undecodable, stored_form, stream_messages
from gaugeflow.streaming.alerts import emit_alert_events
from gaugeflow.streaming.live import emit_graph_updates


#: Landing files of a batch, which bounds what one sensor can bring into it.
MAX_FILES = 1000


def landed_keys(spark: SparkSession, landing: str) -> dict[str, int]:
    """The payload keys of messages that have landed, as ``learned_keys`` gives them; none where the folder is not there yet."""
    try:
        return learned_keys(read_messages(spark, landing))
    except AnalysisException:
        return {}


def monitored(
    spark: SparkSession, landing: str, max_files: int | None = MAX_FILES, pattern: str | None = None, known: dict[str, int] | None = None
) -> DataFrame:
    """Analyzed messages of a landing folder, of the topics that meet a pattern, in the layout of the message table.

    ``known`` is a dictionary of payload keys, which saves time and changes no
    result; without one it is learned from what has landed.
    """
    raw, _ = split_undecodable(read_messages(spark, landing, streaming=True, max_files=max_files))
    if pattern:
        raw = filter_topics(raw, pattern)
    known = landed_keys(spark, landing) if known is None else known
    return stored_form(analyze_messages(raw, known).filter(F.col("equipment_id") != "unknown"))


def dead_letters(spark: SparkSession, landing: str, max_files: int | None = MAX_FILES) -> DataFrame:
    """Lines of a landing folder that are no message or whose payload is no JSON object, with the reason."""
    lines = read_messages(spark, landing, streaming=True, max_files=max_files)
    reason = F.when(F.col("topic").isNull() | F.col("payload").isNull(), "line is not a message").when(
        parse_payload("payload").isNull(), "payload is not a JSON object"
    )
    return lines.select("topic", "payload", "ingest_ts", F.col("_corrupt_record").alias("line"), reason.alias("reason")).filter(F.col("reason").isNotNull())


def monitor(
    spark: SparkSession,
    landing: str,
    thresholds: DataFrame,
    layout: DataFrame,
    edges: DataFrame,
    out: str,
    checkpoints: str,
    push: Callable[[DataFrame, int], None],
    max_files: int | None = MAX_FILES,
    available_now: bool = False,
    pattern: str | None = None,
) -> dict:
    """Starts four queries over the same landing folder, each with its own checkpoint.

    Storage appends every message of the subscribed topics, lines that can't
    be analyzed go to the dead letters, alerts keep their state per sensor,
    and the graph is pushed at most every 500 milliseconds.
    """
    once = {"availableNow": True} if available_now else {"processingTime": "500 milliseconds"}
    messages = monitored(spark, landing, max_files, pattern)
    dead = dead_letters(spark, landing, max_files).writeStream.format("parquet").option("path", f"{out}/dead_letters")
    return {
        "storage": stream_messages(messages, f"{out}/messages", f"{checkpoints}/storage", **once),
        "dead_letters": dead.option("checkpointLocation", f"{checkpoints}/dead_letters").trigger(**once).start(),
        "alerts": emit_alert_events(messages, thresholds, f"{out}/alerts", f"{checkpoints}/alerts", **once),
        "graph": emit_graph_updates(messages, layout, edges, push, f"{checkpoints}/graph", available_now=available_now),
    }
