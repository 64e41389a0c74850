"""Series behind the equipment charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from gaugeflow.functions.joins import join_keys


def recent_window(readings: DataFrame, seconds: int = 30, by: str = "equipment_id") -> DataFrame:
    """Readings within the last seconds before the newest one of each equipment.

    The newest time per equipment is a small aggregate that is joined back, so
    the readings of a busy equipment never meet in one task.
    """
    newest = readings.groupBy(by).agg(F.max("ts").alias("_newest"))
    return (
        join_keys(readings, newest, [by])
        .filter(F.col("ts") >= F.col("_newest") - F.make_dt_interval(secs=F.lit(seconds)))
        .drop("_newest")
    )


def pivot_series(readings: DataFrame, sensors: list[str], value: str | Column = "value", by: str = "equipment_id") -> DataFrame:
    """One row per equipment and millisecond with a column per sensor.

    The last write at a millisecond wins, missing sensors are NULL and ``i``
    numbers the rows of an equipment from 0. Meant for the output of
    ``recent_window``: a window of s seconds holds at most 1000*s + 1 rows per
    equipment, which bounds the numbering.
    """
    value = F.col(value) if isinstance(value, str) else value
    t = F.unix_millis(F.col("ts").cast("timestamp"))
    order = F.struct("ts", "msg_id")
    wide = (
        readings.withColumn("t", t)
        .groupBy(by, "t")
        .agg(*[F.max_by(F.when(F.col("sensor_type") == s, value), F.when(F.col("sensor_type") == s, order)).alias(s) for s in sensors])
    )
    numbering = W.partitionBy(by).orderBy("t")
    return wide.withColumn("i", F.row_number().over(numbering) - 1)


def available_features(readings: DataFrame, selected: list[str] | None = None) -> DataFrame:
    """Sorted distinct sensors, optionally a selection of them (an empty selection means all)."""
    rows = readings.filter(F.col("sensor_type").isin(selected)) if selected else readings
    return rows.select("sensor_type").distinct().orderBy("sensor_type")


def history_series(messages: DataFrame, project: str, equipment: str, n: int = 100) -> DataFrame:
    """Last ``n`` readings of an equipment in ascending time."""
    return (
        messages.filter((F.col("project_id") == project) & (F.col("equipment_id") == equipment))
        .orderBy(F.desc("msg_id"))
        .limit(n)
        .orderBy("ts", "msg_id")
    )
