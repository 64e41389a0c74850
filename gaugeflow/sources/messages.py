"""Landing folder of raw messages and the table of recorded messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

MESSAGE_SCHEMA = "msg_id long, topic string, payload string, ingest_ts timestamp, project_id string, session_id string"
STORED_COLUMNS = [
    "id", "project_id", "session_id", "msg_id", "ts", "equipment_id", "sensor_type", "value", "value_str", "value_json", "unit", "status", "topic", "raw_payload",
]


def read_messages(spark: SparkSession, path: str, streaming: bool = False, max_files: int | None = None) -> DataFrame:
    """Raw messages from JSON lines ``{msg_id, topic, payload, ingest_ts, …}``.

    A line that cannot be read arrives with a NULL topic and its text in
    ``_corrupt_record``; ``split_undecodable`` takes such lines apart. A
    message without a time gets the time of its arrival.
    """
    reader = spark.readStream if streaming else spark.read
    reader = reader.schema(MESSAGE_SCHEMA + ", _corrupt_record string").option("mode", "PERMISSIVE")
    if streaming and max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path).withColumn("ingest_ts", F.coalesce("ingest_ts", F.current_timestamp()))


def split_undecodable(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readable messages, and the lines that are not messages."""
    readable = F.col("topic").isNotNull() & F.col("payload").isNotNull()
    return messages.filter(readable).drop("_corrupt_record"), messages.filter(~readable)


def stored_form(analyzed: DataFrame) -> DataFrame:
    """Analyzed messages in the layout of the message table.

    The id is a hash of what makes a message unique, so that a repeated write
    can be recognized.
    """
    ident = F.sha2(F.to_json(F.struct("project_id", "session_id", "topic", "msg_id", F.col("ingest_ts").cast("string"), "payload")), 256)
    return analyzed.select(
        F.concat(F.lit("msg_"), ident).alias("id"),
        "project_id",
        "session_id",
        "msg_id",
        F.col("ingest_ts").alias("ts"),
        "equipment_id",
        "sensor_type",
        F.col("value_num").alias("value"),
        "value_str",
        "value_json",
        F.coalesce("reading_unit", F.lit("")).alias("unit"),
        F.coalesce("status", F.lit("active")).alias("status"),
        "topic",
        F.col("payload").alias("raw_payload"),
    )


def write_messages(messages: DataFrame, path: str, mode: str = "append") -> None:
    """Appends to the message table, partitioned by project and session.

    The rebalance hint sizes the files and splits a busy session over several
    tasks instead of one.
    """
    messages.hint("rebalance", F.col("project_id"), F.col("session_id")).write.mode(mode).partitionBy("project_id", "session_id").parquet(path)


def stream_messages(messages: DataFrame, path: str, checkpoint: str, **trigger):
    """Appends a stream to the message table; the sink commits every file once."""
    writer = messages.writeStream.format("parquet").partitionBy("project_id", "session_id").option("path", path)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
