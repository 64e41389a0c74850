"""Classification and scoring of the fields of a JSON payload.

A payload is parsed once into ``map<string,variant>``, which keeps both the
document order and the JSON types, and is turned into an array of typed
``field`` structs. Everything derived from it is a plain column expression.

All keyword tests are substring tests on the lower-cased key, so ``humidity``
counts as an id-like key (it contains ``id``) and ``flow`` as a lower bound.
They are made once for each distinct key of a sample: a dictionary keeps the
outcome as a bit mask, which messages look up; other keys are tested in place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from gaugeflow.functions.topics import as_col

# Keywords of the field heuristics.
KEYWORDS = {
    "id": ["id", "device", "equipment", "node", "unit", "machine"],
    "id_or_time": ["id", "time", "stamp", "date", "count", "index"],
    "value": [
        "value", "reading", "measurement", "level", "amount", "data", "temperature", "pressure", "humidity", "voltage", "current", "power",
        "speed", "flow", "rate", "count", "percent", "ratio", "index", "concentration", "density", "weight", "mass", "force", "torque", "ph",
        "dissolved", "viability", "impedance", "confluence",
    ],
    "not_value": ["id", "time", "stamp", "date", "version", "count", "index", "key", "hash"],
    "id_score": [
        "id", "device", "equipment", "node", "unit", "sensor", "machine", "name", "label", "tag", "serial", "address", "handle", "ref",
    ],
    "description": ["type", "kind", "category", "class", "name"],
    "status": ["status", "state", "health", "condition"],
    "unit": ["unit", "uom", "dimension", "scale"],
    "min": ["min", "lower", "low"],
    "max": ["max", "upper", "high", "limit"],
    "sensor_type": ["type", "kind", "category", "class"],
    "time": ["time", "stamp", "date"],
}
#: Each keyword list is a bit of a key's mask.
BITS = {name: 1 << i for i, name in enumerate(KEYWORDS)}


def key_mask(key) -> Column:
    """The keyword lists that the lower-cased key contains a word of, a bit for each."""
    lowered = F.lower(as_col(key))
    found = [F.when(reduce(Column.__or__, [lowered.contains(w) for w in words]), F.lit(BITS[name])).otherwise(F.lit(0)) for name, words in KEYWORDS.items()]
    return reduce(Column.__add__, found)


def looked_up_mask(key, known: dict[str, int]) -> Column:
    """``key_mask`` of a key: from the dictionary of known keys where it is one of them, else by its words."""
    key = as_col(key)
    if not known:
        return key_mask(key)
    table = F.map_from_arrays(F.lit(list(known)), F.lit(list(known.values())))
    return F.coalesce(F.try_element_at(table, key), key_mask(key))


def _has(key: Column, name: str, mask: Column | None = None) -> Column:
    """True where the key contains a word of the list, by its mask if that is there."""
    if mask is not None:
        return mask.bitwiseAND(F.lit(BITS[name])) != 0
    return F.lower(key).rlike("|".join(KEYWORDS[name]))


def looks_like_identifier(key, value, mask: Column | None = None) -> Column:
    """Id-like key, or a short text that is alphanumeric or has an underscore."""
    key, value = as_col(key), as_col(value)
    short = (F.length(value) <= 20) & (value.contains("_") | value.rlike(r"^[\p{L}\p{N}]+$"))
    return F.coalesce(_has(key, "id", mask) | F.coalesce(short, F.lit(False)), F.lit(False))


def looks_like_datetime(value) -> Column:
    value = as_col(value)
    return F.coalesce((F.length(value) > 10) & value.rlike(r"[TZ:+\-]"), F.lit(False))


def is_id_or_time_key(key, mask: Column | None = None) -> Column:
    return _has(as_col(key), "id_or_time", mask)


def _bonus(condition: Column, points: float) -> Column:
    return F.when(condition, F.lit(points)).otherwise(F.lit(0.0))


def main_value_score(key, number, mask: Column | None = None) -> Column:
    key, number = as_col(key), as_col(number)
    score = (
        F.lit(0.5)
        + _bonus(_has(key, "value", mask), 0.4)
        + _bonus(number.between(-10000, 100000), 0.2)
        + _bonus(number.between(0, 1000), 0.1)
        - _bonus(_has(key, "not_value", mask), 0.3)
    )
    return F.greatest(F.lit(0.0), score)


def identifier_score(key, text=None, number=None, mask: Column | None = None) -> Column:
    """Score as an identifier; give ``text`` for strings, ``number`` for integers."""
    key = as_col(key)
    score = F.lit(0.3) + _bonus(_has(key, "id_score", mask), 0.5)
    if text is not None:
        text = as_col(text)
        bare = F.regexp_replace(text, "[_-]", "")
        score = score + _bonus((F.length(text) <= 30) & bare.rlike(r"^[\p{L}\p{N}]+$"), 0.3)
        score = score + _bonus(text.rlike(r"\p{Nd}"), 0.2)
    elif number is not None:
        score = score + _bonus(as_col(number).between(0, 10000), 0.2)
    return score


def description_score(key, mask: Column | None = None) -> Column:
    return F.lit(0.2) + _bonus(_has(as_col(key), "description", mask), 0.3)


def parse_payload(payload) -> Column:
    """Payload text as ``map<string,variant>``; NULL unless it is a JSON object."""
    return F.from_json(as_col(payload), "map<string,variant>")


def payload_entries(parsed: Column) -> Column:
    """Key/value entries in document order.

    For a repeated key the last value counts, at the place of the first one.
    """
    keys = F.map_keys(parsed)
    entries = F.map_entries(parsed)
    unique = F.array_distinct(keys)
    merged = F.transform(
        unique,
        lambda k: F.struct(
            k.alias("key"),
            F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"].alias("value"),
        ),
    )
    return F.when(F.size(unique) == F.size(keys), entries).otherwise(merged)


def is_number_type(name: Column) -> Column:
    return name.startswith("DECIMAL") | name.startswith("BIGINT") | name.startswith("DOUBLE") | name.startswith("FLOAT")


def kind_of_type(name: Column) -> Column:
    """``number, boolean, string, object, array`` or ``null`` from the type text of a variant."""
    return (
        F.when(name == "STRING", F.lit("string"))
        .when(is_number_type(name), F.lit("number"))
        .when(name == "BOOLEAN", F.lit("boolean"))
        .when(name.startswith("OBJECT"), F.lit("object"))
        .when(name.startswith("ARRAY"), F.lit("array"))
        .otherwise(F.lit("null"))
    )


def variant_kind(value: Column) -> Column:
    return kind_of_type(F.schema_of_variant(value))


def value_text(kind: Column, value: Column) -> Column:
    """Printed form of any payload value."""
    text = F.try_variant_get(value, "$", "string")
    return F.when(kind == "null", F.lit("None")).when(kind == "boolean", F.initcap(text)).otherwise(text)


def typed_fields(entries, known: dict[str, int] | None = None) -> Column:
    """``array<struct<pos,key,mask,kind,num,str,value>>`` from the payload entries.

    ``num`` is set for numbers and booleans (true counts as 1), ``str`` for
    strings, ``value`` is the variant itself, and ``mask`` has the keyword
    lists of the key. The type text is taken in a transform of its own, so that
    it is made once; further steps would each copy every field.
    """

    def name_type(entry: Column, pos: Column) -> Column:
        return F.struct(
            pos.alias("pos"),
            entry["key"].alias("key"),
            looked_up_mask(entry["key"], known or {}).alias("mask"),
            F.schema_of_variant(entry["value"]).alias("type"),
            entry["value"].alias("value"),
        )

    def read(f: Column) -> Column:
        name, value = f["type"], f["value"]
        number = F.when(name == "STRING", F.lit(None)).when(is_number_type(name), F.try_variant_get(value, "$", "double"))
        truth = F.when(F.try_variant_get(value, "$", "boolean"), F.lit(1.0)).otherwise(F.lit(0.0))
        return keep(
            f, "pos", "key", "mask", "value",
            kind=kind_of_type(name),
            num=number.when(name == "BOOLEAN", truth),
            str=F.when(name == "STRING", F.try_variant_get(value, "$", "string")),
        )

    return F.transform(F.transform(as_col(entries), name_type), read)


def keep(f: Column, *names: str, **more: Column) -> Column:
    """A struct with some members of another one and additional ones."""
    return F.struct(*[f[n].alias(n) for n in names], *[c.alias(n) for n, c in more.items()])


BASE_FIELDS = ("pos", "key", "mask", "value", "kind", "num", "str")


def classify_fields(fields) -> Column:
    """Adds ``as`` with ``category`` and ``score`` to the typed fields.

    ``category`` is numeric, identifier, datetime, description, object, array
    or NULL (JSON null). ``score`` ranks the candidates of a category: numbers
    as main value (NULL for id- and time-like keys), texts as identifier or
    description. One branch gives both, so that no test is made twice.
    """

    def outcome(category: Column, score: Column | None = None) -> Column:
        return F.struct(category.alias("category"), (F.lit(None).cast("double") if score is None else score).alias("score"))

    def classify(f: Column) -> Column:
        key, mask, text = f["key"], f["mask"], f["str"]
        number = F.when(~is_id_or_time_key(key, mask), main_value_score(key, f["num"], mask))
        found = (
            F.when(f["num"].isNotNull(), outcome(F.lit("numeric"), number))
            .when(text.isNull(), outcome(F.when(f["kind"] != "null", f["kind"])))
            .when(looks_like_identifier(key, text, mask), outcome(F.lit("identifier"), identifier_score(key, text=text, mask=mask)))
            .when(looks_like_datetime(text), outcome(F.lit("datetime")))
            .otherwise(outcome(F.lit("description"), description_score(key, mask)))
        )
        return F.struct(*[f[n].alias(n) for n in BASE_FIELDS], found.alias("as"))

    return F.transform(as_col(fields), classify)


FIELD_TYPE = "struct<pos:int,key:string,mask:int,value:variant,kind:string,num:double,str:string,as:struct<category:string,score:double>>"
FOUND_TYPE = {
    **{n: FIELD_TYPE for n in ("numeric", "identifier", "description", "any_numeric", "any_description", "unit")},
    **{n: "string" for n in ("status", "sensor_type", "time_text")},
    **{n: "double" for n in ("min_value", "max_value")},
}


def scan_fields(fields) -> Column:
    """One pass over the classified fields that keeps what the readings need.

    The best candidate of each category (ties go to the first), the first
    number and description, the first status, unit, type and time entries and
    the last range bounds. Slots that are filled already are not tested again,
    nor those that a field of its type can't fill.
    """

    def step(acc: Column, f: Column) -> Column:
        def best(category: str) -> Column:
            won = (f["as"]["category"] == category) & (f["as"]["score"] > F.coalesce(acc[category]["as"]["score"], F.lit(-1.0)))
            return F.when(won, f).otherwise(acc[category])

        def first(name: str, condition: Column, value: Column = f) -> Column:
            return F.when(acc[name].isNotNull(), acc[name]).when(condition, value)

        def has(name: str) -> Column:
            return _has(f["key"], name, f["mask"])

        def updated(**slots: Column) -> Column:
            return F.struct(*[slots.get(n, acc[n]).alias(n) for n in FOUND_TYPE])

        unit = first("unit", has("unit"))
        number = updated(
            numeric=best("numeric"),
            any_numeric=F.coalesce(acc["any_numeric"], f),
            unit=unit,
            min_value=F.when(has("min"), f["num"]).otherwise(acc["min_value"]),
            max_value=F.when(has("max") & ~has("min"), f["num"]).otherwise(acc["max_value"]),
        )
        text = updated(
            identifier=best("identifier"),
            description=best("description"),
            any_description=first("any_description", f["as"]["category"] == "description"),
            unit=unit,
            status=first("status", has("status"), f["str"]),
            sensor_type=first("sensor_type", has("sensor_type"), f["str"]),
            time_text=first("time_text", has("time") & looks_like_datetime(f["str"]), f["str"]),
        )
        return F.when(f["num"].isNotNull(), number).when(f["str"].isNotNull(), text).otherwise(updated(unit=unit))

    start = F.struct(*[F.lit(None).cast(t).alias(n) for n, t in FOUND_TYPE.items()])
    return F.aggregate(as_col(fields), start, step)


def first_field(fields: Column, condition) -> Column:
    """First field that meets the condition, NULL if none does."""
    return F.try_element_at(F.filter(fields, condition), F.lit(1))
