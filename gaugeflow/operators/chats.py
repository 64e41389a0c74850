"""Chat sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gaugeflow.functions.text import extract_references

KEPT_SESSIONS = 10


def message_references(conversations: DataFrame) -> DataFrame:
    """Messages with the sensors and cells they refer to."""
    return conversations.withColumn("references", extract_references("text")).filter(F.size("references") > 0)


def chat_sessions(conversations: DataFrame, keep: int = KEPT_SESSIONS, updated: str = "conv_id") -> DataFrame:
    """The most recently updated chats with their messages counted, not counting the greeting."""
    return (
        conversations.groupBy("conv_id")
        .agg((F.count(F.lit(1)) - 1).alias("messages"), F.max(updated).alias("last_updated"))
        .orderBy(F.desc("last_updated"), F.desc("conv_id"))
        .limit(keep)
    )
