"""Discovered sensors and equipment."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gaugeflow.functions.topics import equipment_type, topic_leaf


def sensor_registry(analyzed: DataFrame) -> DataFrame:
    """One row per equipment and sensor with the latest topic, sample and time.

    ``analyzed`` needs ``equipment_id, sensor_type, topic, payload, ingest_ts,
    msg_id``. Rows with an unknown equipment or sensor are left out.
    """
    order = F.struct("ingest_ts", "msg_id")
    return (
        analyzed.filter((F.col("equipment_id") != "unknown") & (F.col("sensor_type") != "unknown"))
        .groupBy("equipment_id", "sensor_type")
        .agg(
            F.max_by(F.struct("topic", F.col("payload").alias("sample_data")), order).alias("n"),
            F.max("ingest_ts").alias("last_seen"),
            F.min(order).alias("first_key"),
            F.count(F.lit(1)).alias("message_count"),
        )
        .select("equipment_id", "sensor_type", "n.topic", "n.sample_data", "last_seen", "first_key", "message_count")
    )


def discovered_nodes(registry: DataFrame) -> DataFrame:
    """One row per equipment over its registry entries.

    ``sensor_count`` counts registry entries, ``message_count`` the messages.
    The sample is the one of the entry seen first.
    """
    nodes = registry.groupBy("equipment_id").agg(
        F.array_sort(F.collect_set("topic")).alias("topics"),
        F.min_by("sample_data", "first_key").alias("sample_data"),
        F.count(F.lit(1)).alias("sensor_count"),
        F.sum("message_count").alias("message_count"),
        F.min("last_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.max_by("topic", "first_key").alias("_topic"),
    )
    return nodes.select(
        F.concat(F.lit("node_"), "equipment_id").alias("id"),
        "equipment_id",
        equipment_type("equipment_id", "_topic").alias("equipment_type"),
        "topics",
        "sample_data",
        "sensor_count",
        "message_count",
        "first_seen",
        "last_seen",
    )


def equipment_options(nodes: DataFrame) -> DataFrame:
    return nodes.select("equipment_id").filter(F.coalesce("equipment_id", F.lit("")) != "").distinct().orderBy("equipment_id")


def sensor_options(nodes: DataFrame, equipment: str | None = None) -> DataFrame:
    """Distinct last topic levels per equipment, or of one equipment."""
    rows = nodes if equipment is None else nodes.filter(F.col("equipment_id") == equipment)
    return (
        rows.select("equipment_id", F.explode("topics").alias("topic"))
        .select("equipment_id", topic_leaf("topic").alias("sensor"))
        .distinct()
    )


def available_nodes(discovered: DataFrame, canvas: DataFrame, seen_at) -> DataFrame:
    """Discovered nodes and the canvas nodes that were not discovered, with defaults."""
    cols = ["id", "equipment_id", "equipment_type", "topics", "sample_data", "message_count", "first_seen", "last_seen"]
    missing = canvas.join(discovered.select("equipment_id"), "equipment_id", "left_anti").select(
        F.col("equipment_id").alias("id"),
        "equipment_id",
        (F.coalesce("equipment_type", F.lit("unknown")) if "equipment_type" in canvas.columns else F.lit("unknown")).alias("equipment_type"),
        F.array().cast("array<string>").alias("topics"),
        F.lit("{}").alias("sample_data"),
        F.lit(0).cast("bigint").alias("message_count"),
        seen_at.alias("first_seen"),
        seen_at.alias("last_seen"),
    )
    return discovered.select(*cols).unionByName(missing)


def prune_inactive(canvas: DataFrame, discovered: DataFrame) -> DataFrame:
    """Canvas nodes whose equipment is still discovered."""
    return canvas.join(discovered.select("equipment_id"), "equipment_id", "left_semi")


def project_summaries(projects: DataFrame) -> DataFrame:
    """Node count, distinct equipment types and broker of each project."""
    return projects.select(
        "id",
        "name",
        "description",
        "created_at",
        "updated_at",
        "last_accessed",
        F.coalesce("is_favorite", F.lit(False)).alias("is_favorite"),
        F.coalesce(F.size("graph_layout.nodes"), F.lit(0)).alias("node_count"),
        F.array_distinct(F.coalesce(F.transform("discovered_nodes", lambda n: n["equipment_type"]), F.array().cast("array<string>"))).alias(
            "equipment_types"
        ),
        F.col("mqtt_config.broker_host").alias("broker_host"),
    )
