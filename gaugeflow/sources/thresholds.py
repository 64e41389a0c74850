"""Alert thresholds from CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import Window as W

from gaugeflow.functions.topics import topic_leaf

REQUIRED = ["topic_name", "min_value", "max_value"]


class ThresholdFileError(ValueError):
    """A threshold file that is rejected as a whole."""


def numbered_rows(rows: DataFrame) -> DataFrame:
    """Adds ``row_number`` per file; the first row after the header is number 2.

    Rows are counted per file block and the counts of earlier blocks are added,
    so the rows themselves are never brought together.
    """
    placed = rows.select("*", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("_at"))
    block = ["file_path", "file_block_start"]
    # ids of one block are consecutive, as a block is read by one task
    blocks = placed.groupBy(*block).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("n"))
    earlier = W.partitionBy("file_path").orderBy("file_block_start").rowsBetween(W.unboundedPreceding, -1)
    offsets = blocks.withColumn("_offset", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    return (
        placed.join(offsets, block)
        .withColumn("row_number", F.col("_at") - F.col("_first") + F.col("_offset") + 2)
        .drop("_at", "_first", "_offset", "file_block_start")
    )


def threshold_rows(spark: SparkSession, path: str) -> DataFrame:
    """All rows with parsed bounds and an ``error`` for those that are not valid."""
    raw = spark.read.option("header", True).csv(path)
    if not set(REQUIRED) <= set(raw.columns):
        raise ThresholdFileError(f"CSV must contain columns: {', '.join(REQUIRED)}")

    def bound(name: str):
        return F.nullif(F.trim(F.coalesce(F.col(name), F.lit(""))), F.lit(""))

    low, high, topic = bound("min_value"), bound("max_value"), F.trim(F.col("topic_name"))

    def number(x):
        # Casting alone would also take the suffixes d and f.
        return F.when(x.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(?i:inf|infinity|nan)$"), x.try_cast("double"))

    low_number, high_number = number(low), number(high)
    error = (
        F.when((low.isNotNull() & low_number.isNull()) | (high.isNotNull() & high_number.isNull()), F.lit("Invalid numeric value in min_value or max_value"))
        .when(low.isNull() & high.isNull(), F.lit("At least one of min_value or max_value must be specified"))
        .when(F.coalesce(topic, F.lit("")) == "", F.lit("Error parsing row"))
    )
    return numbered_rows(raw).select(
        "file_path", "row_number", topic.alias("topic_name"), topic_leaf(topic).alias("sensor_type"),
        low_number.alias("min_value"), high_number.alias("max_value"), error.alias("error"),
    )


def read_thresholds_csv(spark: SparkSession, path: str, project_id: str) -> DataFrame:
    """Thresholds of a CSV file with ``topic_name, min_value, max_value``.

    The file is rejected with the first bad row, or when it has no rows. The
    project is required: thresholds only meet messages of their project.
    """
    rows = threshold_rows(spark, path)
    first_bad = F.min_by("error", F.when(F.col("error").isNotNull(), F.col("row_number")))
    check = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("error").isNotNull(), F.col("row_number"))).alias("at"), first_bad.alias("why")).first()
    if check.at is not None:
        raise ThresholdFileError(f"Row {check.at}: {check.why}")
    if check.n == 0:
        raise ThresholdFileError("No valid alert thresholds found in CSV")
    safe = F.replace("topic_name", F.lit("/"), F.lit("_"))
    suffix = F.substring(F.md5(F.concat_ws("|", "file_path", "topic_name", "row_number")), 1, 8)
    return rows.select(
        F.concat_ws("_", safe, F.col("row_number").cast("string"), suffix).alias("id"),
        F.lit(project_id).cast("string").alias("project_id"),
        F.col("row_number").alias("ord"),
        "topic_name",
        "sensor_type",
        "min_value",
        "max_value",
        F.lit(True).alias("enabled"),
        F.current_timestamp().alias("created_at"),
    )
