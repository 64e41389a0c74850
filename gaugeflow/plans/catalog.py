"""All registered queries; importing this module fills the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugeflow.operators.series import scan_series, statistics, time_range_absolute
from gaugeflow.plans import (  # noqa: F401
    knowledge_queries,
    learner_queries,
    live_queries,
    series_queries,
    storage_queries,
    stream_queries,
)
from gaugeflow.plans.registry import ORACLES, QUERIES  # noqa: F401
from gaugeflow.plans.standins import readings


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-cell statistics of the click sensor over one week."""
    rows = time_range_absolute(scan_series(readings(spark, sf_dir), sensors=["click"]), "2024-01-08", "2024-01-14")
    return statistics(rows, ["cell_id"]).withColumn("mean_value", F.round("mean_value", 6))
