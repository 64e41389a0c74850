"""Column functions that derive a normalized reading from topic and payload fields.

``found`` is the result of ``scan_fields`` and ``fields`` the classified
fields it was made from.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gaugeflow.functions.fields import first_field, value_text, variant_kind
from gaugeflow.functions.topics import as_col, looks_like_topic_identifier


def equipment_id(parts, found) -> Column:
    """Equipment a message stands for.

    Three-level topics name it in the first two levels. Otherwise the first
    id-like level after the root, then the best identifier in the payload, then
    the first levels of the topic.
    """
    parts, found = as_col(parts), as_col(found)
    depth = F.size(parts)
    # the level before an id-like level, joined with it; the root has none before it
    pairs = F.transform(
        parts, lambda part, i: F.when((i > 0) & looks_like_topic_identifier(part), F.concat_ws("_", F.get(parts, i - 1), part))
    )
    pair = F.try_element_at(F.filter(pairs, lambda p: p.isNotNull()), F.lit(1))
    best = found["identifier"]["str"]
    leading = F.concat_ws("_", F.slice(parts, 1, 2))
    return F.when(depth == 3, leading).otherwise(
        F.coalesce(pair, F.when(best.rlike(r"^\p{Nd}+$"), F.concat_ws("_", parts[0], best)), best, leading)
    )


def sensor_type(parts, found) -> Column:
    """What a message measures: topic levels first, then the payload."""
    parts, found = as_col(parts), as_col(found)
    leaf = F.element_at(parts, -1)
    second_last = F.try_element_at(parts, F.lit(-2))
    # an empty leaf is no identifier, so after the second rule the leaf is one or empty
    return (
        F.when(F.size(parts) == 3, leaf)
        .when((leaf != "") & ~looks_like_topic_identifier(leaf), leaf)
        .when((leaf != "") & (F.coalesce(second_last, F.lit("")) != ""), second_last)
        .otherwise(F.coalesce(found["description"]["str"], found["numeric"]["key"], F.lit("sensor")))
    )


def main_value(fields, found) -> Column:
    """The field to show.

    Best scored number, else any number, else the first text that is neither
    an identifier nor a date, else the first field.
    """
    found = as_col(found)
    return F.coalesce(found["numeric"], found["any_numeric"], found["any_description"], F.try_element_at(as_col(fields), F.lit(1)))


def typed_value(field) -> Column:
    """``struct<kind,num,str,text>`` of a field; its type is known already."""
    field = as_col(field)
    parts = {"kind": field["kind"], "num": field["num"], "str": field["str"], "text": value_text(field["kind"], field["value"])}
    return F.when(field.isNotNull(), F.struct(*[c.alias(n) for n, c in parts.items()]))


def infer_status(found, value_num) -> Column:
    number = as_col(value_num)
    return F.coalesce(
        as_col(found)["status"],
        F.when(number < 0, F.lit("error")).when(number == 0, F.lit("idle")).when(number > 0, F.lit("active")),
        F.lit("unknown"),
    )


def object_fields(fields) -> Column:
    """The fields whose value is an object; most payloads have none."""
    return F.filter(as_col(fields), lambda f: f["kind"] == "object")


def extract_metadata(found, objects) -> Column:
    """``struct<unit,min_value,max_value,sensor_type,objects>``; ``objects`` are the payload's object fields.

    Minimum is tested before maximum and the last match counts. An object
    field with the same name replaces the extracted entry.
    """
    found, objects = as_col(found), as_col(objects)
    none = F.size(objects) == 0

    def printed(f: Column) -> Column:
        return F.try_variant_get(f["value"], "$", "string")

    def replaced(name: str) -> Column:
        return F.when(~none, first_field(objects, lambda f: f["key"] == name))

    everything = F.map_from_arrays(F.transform(objects, lambda f: f["key"]), F.transform(objects, printed))
    return F.struct(
        F.coalesce(printed(replaced("unit")), value_text(found["unit"]["kind"], found["unit"]["value"])).alias("unit"),
        F.when(replaced("min_value").isNull(), found["min_value"]).alias("min_value"),
        F.when(replaced("max_value").isNull(), found["max_value"]).alias("max_value"),
        F.coalesce(printed(replaced("sensor_type")), found["sensor_type"]).alias("sensor_type"),
        F.when(none, F.create_map().cast("map<string,string>")).otherwise(everything).alias("objects"),
    )


def confidence(parts, fields, found, equipment, sensor) -> Column:
    depth, found = F.size(as_col(parts)), as_col(found)

    def points(condition: Column, n: float) -> Column:
        return F.when(condition, F.lit(n)).otherwise(F.lit(0.0))

    score = (
        F.lit(0.5)
        + F.when(depth >= 3, F.lit(0.2)).when(depth == 2, F.lit(0.1)).otherwise(F.lit(0.0))
        + points(F.size(as_col(fields)) >= 3, 0.1)
        + points(found["numeric"].isNotNull(), 0.1)
        + points(found["identifier"].isNotNull(), 0.1)
        - points(as_col(equipment) == "device_unknown", 0.2)
        - points(as_col(sensor) == "sensor", 0.1)
    )
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.1), score)), 6)


def reading_unit(fields) -> Column:
    """Unit of the payload, else the last ``_`` token of its ``field`` entry, else empty."""
    fields = as_col(fields)
    unit = first_field(fields, lambda f: f["key"] == "unit")
    filled = ((unit["kind"] == "string") & (unit["str"] != "")) | (unit["num"] != 0) | unit["kind"].isin("object", "array")
    name = first_field(fields, lambda f: f["key"] == "field")["str"]
    return F.coalesce(
        F.when(filled, value_text(unit["kind"], unit["value"])),
        F.when(name.contains("_"), F.element_at(F.split(name, "_"), -1)),
        F.lit(""),
    )


def leading_number(text) -> Column:
    """Number at the start of a text, NULL if it does not start with one."""
    prefix = F.regexp_extract(as_col(text), r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return F.when(prefix != "", prefix.try_cast("double"))


def to_numeric(kind, num, text) -> Column:
    """Chart value: a number as is, a text by its leading number, an object or
    array by its first numeric member, anything else 0."""
    kind, num, text = as_col(kind), as_col(num), as_col(text)

    def first_number(values: Column) -> Column:
        numbers = F.filter(values, lambda v: variant_kind(v) == "number")
        return F.try_variant_get(F.try_element_at(numbers, F.lit(1)), "$", "double")

    return F.coalesce(
        F.when(kind == "number", num)
        .when(kind == "string", leading_number(text))
        .when(kind == "object", first_number(F.map_values(F.from_json(text, "map<string,variant>"))))
        .when(kind == "array", first_number(F.from_json(text, "array<variant>"))),
        F.lit(0.0),
    )


def range_status(value, low, high) -> Column:
    """``alarm`` in the outer 5 % of the range, ``warning`` in the outer 15 %, else ``normal``.

    NULL where the range is empty.
    """
    value, low, high = as_col(value), as_col(low), as_col(high)
    span = F.when(high != low, high - low)
    position = (value - low) / span
    return (
        F.when(position.isNull(), F.lit(None).cast("string"))
        .when((position < 0.05) | (position > 0.95), F.lit("alarm"))
        .when((position < 0.15) | (position > 0.85), F.lit("warning"))
        .otherwise(F.lit("normal"))
    )
