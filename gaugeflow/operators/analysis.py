"""From raw messages to normalized readings."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, functions as F

from gaugeflow.functions import fields as P
from gaugeflow.functions import readings as R
from gaugeflow.functions.topics import topic_parts, topic_pattern_regex


def filter_topics(messages: DataFrame, pattern: str | None) -> DataFrame:
    """Messages whose topic meets a subscription pattern."""
    return messages.filter(F.col("topic").rlike(topic_pattern_regex(pattern)))


def split_dead_letters(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages with a JSON object as payload, and the rest with a reason."""
    parsed = messages.withColumn("_parsed", P.parse_payload("payload"))
    good = parsed.filter(F.col("_parsed").isNotNull()).drop("_parsed")
    dead = parsed.filter(F.col("_parsed").isNull()).drop("_parsed").withColumn("reason", F.lit("payload is not a JSON object"))
    return good, dead


#: Messages that keys are learned from, and keys that are kept; a literal of this size goes to every task.
KEY_SAMPLE, KNOWN_KEYS = 10_000, 256


def learned_keys(messages: DataFrame, sample: int = KEY_SAMPLE) -> dict[str, int]:
    """The most frequent payload keys of the first messages, each with its mask of keyword lists.

    The dictionary saves time and changes no result: keys outside it are
    tested where they occur. A stream can't be looked into; give it the
    dictionary of recorded messages, or none.
    """
    if messages.isStreaming:
        return {}
    keys = messages.select("payload").limit(sample).select(F.explode(F.json_object_keys("payload")).alias("key"))
    frequent = keys.groupBy("key").count().orderBy(F.desc("count"), "key").limit(KNOWN_KEYS)
    return {r["key"]: r["mask"] for r in frequent.select("key", P.key_mask("key").alias("mask")).collect()}


@lru_cache(maxsize=4)
def _field_columns(application: str, known: tuple) -> tuple:
    """The large field expressions, built once per application and dictionary."""
    fields = P.classify_fields(P.typed_fields(P.payload_entries(F.col("_parsed")), dict(known)))
    return fields, P.scan_fields("fields")


def with_fields(messages: DataFrame, known: dict[str, int] | None = None) -> DataFrame:
    """Adds topic ``parts``, the classified ``fields`` and what a scan ``found`` in them.

    ``known`` is a dictionary of keys as ``learned_keys`` gives it; without one
    it is learned from the first messages, with ``{}`` every key is tested in
    place. Messages without an object payload drop out. They do so in a
    generator and not in a filter, which would be pushed down and parse every
    payload twice. ``found`` also comes out of a generator: a filter on what is
    read from it stays behind and does not scan the fields again.
    """
    known = learned_keys(messages) if known is None else known
    parsed = F.array_compact(F.array(P.parse_payload("payload")))
    fields, found = _field_columns(messages.sparkSession.sparkContext.applicationId, tuple(sorted(known.items())))
    return (
        messages.withColumn("_parsed", F.explode(parsed))
        .withColumn("fields", fields)
        .withColumn("found", F.explode(F.array(found)))
        .withColumn("objects", R.object_fields("fields"))
        .withColumn("parts", topic_parts("topic"))
        .drop("_parsed")
    )


def payload_fields(messages: DataFrame) -> DataFrame:
    """One row per payload field with its category and score."""
    f = F.col("f")
    return (
        with_fields(messages)
        .select("msg_id", "topic", F.explode("fields").alias("f"))
        .select(
            "msg_id", "topic", "f.pos", "f.key", "f.kind", "f.num", "f.str", P.value_text(f["kind"], f["value"]).alias("text"), "f.as.category", "f.as.score"
        )
    )


def analyze_messages(messages: DataFrame, known: dict[str, int] | None = None) -> DataFrame:
    """Normalized readings of messages ``(msg_id, topic, payload, ingest_ts, …)``.

    A projection: no shuffle and no Python. Extra columns pass through.
    ``known`` is a dictionary of payload keys, see ``with_fields``.
    """
    derived = with_fields(messages, known).withColumns(
        {
            "equipment_id": R.equipment_id("parts", "found"),
            "sensor_type": R.sensor_type("parts", "found"),
            "value": R.typed_value(R.main_value("fields", "found")),
            "metadata": R.extract_metadata("found", "objects"),
            "reading_unit": R.reading_unit("fields"),
            "timestamp_text": F.col("found.time_text"),
        }
    )
    event_ts = F.try_to_timestamp("timestamp_text").cast("timestamp_ntz")
    return derived.withColumns(
        {
            "value_kind": F.col("value.kind"),
            "value_num": F.col("value.num"),
            "value_str": F.col("value.str"),
            "value_json": F.when(F.col("value.kind").isin("object", "array"), F.col("value.text")),
            "status": R.infer_status("found", "value.num"),
            "confidence": R.confidence("parts", "fields", "found", "equipment_id", "sensor_type"),
            "unit": F.coalesce(F.col("metadata.unit"), F.lit("")),
            "display_name": F.trim(F.concat_ws(" ", "equipment_id", "sensor_type")),
            "event_ts": F.coalesce(event_ts, F.col("ingest_ts").cast("timestamp_ntz")),
        }
    ).drop("fields", "found", "objects", "parts", "value")


def fallback_record(messages: DataFrame) -> DataFrame:
    """Low-confidence record for messages whose analysis is not possible."""
    topic = F.col("topic")
    deep = topic.contains("/")
    return messages.select(
        "*",
        F.when(deep, F.split(topic, "/")[0]).otherwise(F.lit("unknown")).alias("equipment_id"),
        F.when(deep, F.element_at(F.split(topic, "/"), -1)).otherwise(F.lit("sensor")).alias("sensor_type"),
        F.lit("unknown").alias("status"),
        F.lit(0.1).alias("confidence"),
        F.lit("").alias("unit"),
        F.lit("Unknown Device").alias("display_name"),
    )
