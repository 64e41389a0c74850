"""Column functions over hierarchical topics such as ``lab/furnace/temperature``."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def topic_pattern_regex(pattern: str | None) -> str:
    """Anchored regular expression of a subscription pattern with ``+`` and ``#``.

    A blank pattern subscribes to everything and outer slashes are ignored.
    ``lab/#`` also matches ``lab`` itself.
    """
    cleaned = (pattern or "").strip().strip("/")
    if cleaned in ("", "#"):
        return "^.*$"
    levels = cleaned.split("/")
    open_ended = levels[-1] == "#"
    if open_ended:
        levels = levels[:-1]
    body = "/".join("[^/]*" if level == "+" else re.escape(level) for level in levels)
    return f"^{body}(/.*)?$" if open_ended else f"^{body}$"


def topic_parts(topic) -> Column:
    return F.split(as_col(topic), "/")


def topic_leaf(topic) -> Column:
    return F.element_at(topic_parts(topic), -1)


def parse_topic(topic) -> Column:
    """``parts, depth, root, leaf, second_last, hierarchy`` of a topic as a struct."""
    parts = topic_parts(topic)
    depth = F.size(parts)
    return F.struct(
        parts.alias("parts"),
        depth.alias("depth"),
        parts[0].alias("root"),
        F.element_at(parts, -1).alias("leaf"),
        F.when(depth > 1, F.try_element_at(parts, F.lit(-2))).alias("second_last"),
        F.when(depth > 1, F.array_join(F.slice(parts, 1, depth - 1), "/")).otherwise(F.lit("")).alias("hierarchy"),
    )


def looks_like_topic_identifier(part) -> Column:
    """Digits only, or at most ten letters, digits and underscores with a non-underscore."""
    part = as_col(part)
    return F.coalesce(part.rlike(r"^(\p{Nd}+|_*[\p{L}\p{N}][\p{L}\p{N}_]*)$") & ((F.length(part) <= 10) | part.rlike(r"^\p{Nd}+$")), F.lit(False))


def equipment_type(equipment, topic) -> Column:
    """Text before the first ``_`` of the equipment id, else the root of the topic."""
    equipment = as_col(equipment)
    return F.lower(
        F.when(equipment.contains("_"), F.split(equipment, "_", 2)[0]).otherwise(F.split(as_col(topic), "/", 2)[0])
    )
