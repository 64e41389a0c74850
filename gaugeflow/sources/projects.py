"""Project documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

PROJECT_SCHEMA = """id string, name string, description string, created_at string, updated_at string, last_accessed string, is_favorite boolean,
    mqtt_config struct<broker_host:string, broker_port:int, topic:string>,
    discovered_nodes array<struct<id:string, equipment_id:string, equipment_type:string, topics:array<string>, message_count:bigint>>,
    graph_layout struct<nodes:array<struct<id:string, data:struct<equipment_id:string, equipment_type:string, label:string>>>,
        edges:array<struct<id:string, source:string, target:string>>>,
    domain_documents array<struct<id:string, filename:string, file_type:string, file_size:bigint, equipment_id:string, sensor_type:string>>,
    alert_thresholds array<struct<id:string, project_id:string, topic_name:string, sensor_type:string, min_value:double, max_value:double, enabled:boolean>>"""


def read_projects(spark: SparkSession, path: str) -> DataFrame:
    """Project documents, one per file, with missing parts filled by their defaults."""
    raw = spark.read.schema(PROJECT_SCHEMA).json(path, multiLine=True)

    def empty(name: str):
        return F.array().cast(raw.schema[name].dataType)

    return raw.filter(F.col("id").isNotNull()).withColumns(
        {
            **{n: F.coalesce(n, empty(n)) for n in ("discovered_nodes", "domain_documents", "alert_thresholds")},
            "graph_layout": F.coalesce("graph_layout", F.from_json(F.lit('{"nodes":[],"edges":[]}'), raw.schema["graph_layout"].dataType)),
            "is_favorite": F.coalesce("is_favorite", F.lit(False)),
        }
    )


def project_nodes(projects: DataFrame) -> DataFrame:
    """Layout nodes of all projects as rows."""
    return projects.select(F.col("id").alias("project_id"), F.explode("graph_layout.nodes").alias("n")).select(
        "project_id", "n.id", "n.data.equipment_id", "n.data.equipment_type", "n.data.label"
    )


def project_edges(projects: DataFrame) -> DataFrame:
    return projects.select(F.col("id").alias("project_id"), F.inline("graph_layout.edges"))


def project_thresholds(projects: DataFrame) -> DataFrame:
    """Thresholds of all projects in their order."""
    return projects.select(F.col("id").alias("pid"), F.posexplode("alert_thresholds").alias("ord", "t")).select(
        F.col("pid").alias("project_id"), "t.id", F.col("ord").cast("bigint").alias("ord"), "t.topic_name", "t.sensor_type", "t.min_value", "t.max_value",
        F.coalesce("t.enabled", F.lit(True)).alias("enabled"),
    )
